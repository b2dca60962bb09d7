import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wattframe.llm import ngram
from wattframe.llm.eliasfano import EliasFano, load, save
from wattframe.llm.text import word_hashes, word_table


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def brute(rows):
    learnt = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for x in learnt for w in x)
    total, different = sum(one.values()), len(one)
    two, three = defaultdict(Counter), defaultdict(Counter)
    for x in learnt:
        y = ["<s>", *x]
        for j in range(1, len(y)):
            two[y[j - 1]][y[j]] += 1
        for j in range(2, len(y)):
            three[y[j - 2], y[j - 1]][y[j]] += 1
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (different + 1))

    def over(counts, context, w, lower):
        if context not in counts:
            return lower
        seen = counts[context]
        return (max(seen[w] - 0.75, 0) + 0.75 * len(seen) * lower) / sum(seen.values())

    out = {}
    for i, t in rows:
        x = ["<s>", *tokens(t)]
        score = math.log10(over(two, "<s>", x[1], p1(x[1])))
        for j in range(2, len(x)):
            score += math.log10(over(three, (x[j - 2], x[j - 1]), x[j], over(two, x[j - 1], x[j], p1(x[j]))))
        out[i, t] = (len(x) - 1, sum(one[w] > 0 for w in x[1:]), total, sum(math.log10(p1(w)) for w in x[1:]), score)
    return out


@pytest.mark.parametrize("chunk, shard", [(1 << 20, 1 << 21), (50, 64)])
def test_scores(make_docs, hard_docs, monkeypatch, chunk, shard):
    monkeypatch.setattr(ngram, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram, "SHARD_TOKENS", shard)
    text = "the cat sat on the mat and the dog sat on the cat then THE Cat ran"
    docs = make_docs([(i, " ".join(text.split()[i % 7:i % 11 + 5]), "a") for i in range(60)])
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in ngram.score_texts(docs).collect():
        n, known, total, base, score = wanted[r.doc_id, docs.where(f"doc_id = {r.doc_id}").first().text] if r.doc_id < 3 else next(v for k, v in wanted.items() if k[0] == r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-9 and abs(r.score - score) < 2.5e-4 * n


def test_hard_rows(hard_docs):
    wanted = brute([(r.doc_id, r.text) for r in hard_docs.collect()])
    got = ngram.score_texts(hard_docs).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got if r.doc_id != 6) == sorted((v[0], v[1], round(v[3], 6)) for k, v in wanted.items() if k[0] != 6)
    assert ngram.score_texts(hard_docs.limit(0)).count() == 0


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(3)
    for values in ([], [0], [5, 5, 5], rng.integers(0, 10, 500), rng.integers(0, 2**62, 1000), rng.integers(0, 3000, 1000) * 1000, [0] * 300 + [2**62]):
        values = np.sort(np.array(values, dtype=np.uint64))
        save(f"{tmp_path}/x", EliasFano.encode(values).arrays())
        ef = EliasFano(*load(f"{tmp_path}/x"))
        assert (ef.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), np.maximum(values, np.uint64(1)) - np.uint64(1), np.array([0, 7, 2**62 + 5], dtype=np.uint64)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((ef.find(asked) >= 0) == np.isin(asked, values)).all()


def test_scores_sort_once_a_level(make_docs, monkeypatch):
    docs = make_docs([(i, "the cat sat on the mat"[i % 5:], "a") for i in range(40)])
    levels = ngram.build_trie(docs.select("text"))
    sorts, unique = [], ngram._unique
    monkeypatch.setattr(ngram, "_unique", lambda a: sorts.append(len(a)) or unique(a))
    h = np.append(word_hashes(b"the cat sat on a mat", word_table()), ngram._END)
    counts, _, total = ngram.Trie(levels).log10(h, np.array([0]))
    assert len(sorts) == 3 and (counts > 0).tolist() == [True] * 4 + [False] + [True] * 2 and (total < 0).all()


def test_word_hashes():
    table = word_table()
    assert len(word_hashes(b"", table)) == 0 and len(word_hashes(b" \n", table)) == 0
    h = word_hashes(("a b a \x00a aa a " + "x" * 9000 + " " + "x" * 9001).encode(), table)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 6
