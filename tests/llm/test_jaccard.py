import os
import random

import numpy as np
import pytest
from test_dedup import LOWER

import corpus_pipeline
from wattframe.llm import jaccard
from wattframe.llm.jaccard import drop_similar_copies, near_copies

FOLDER = "/root/testdata/sf0.01"


def brute_shingles(text, words=5):
    found = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ")
    found = [w for w in found if w]
    return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_jaccard(rows, similarity=0.8):
    """rows: (id, text). Each with the smallest id reachable over all pairs of the similarity."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= similarity * large and (not large or len(both := sets[i] & sets[j]) / (small + large - len(both)) >= similarity):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"neu{rng.randrange(10**6)}"
    return out


def planted():
    """Groups of a text and copies with 1 to 6 edits spread over it, and far texts."""
    rng = random.Random(11)
    rows = []
    for length in (60, 150, 400):
        for _ in range(25):
            base = [f"w{rng.randrange(3000)}" for _ in range(length)]
            rows += [base] + [edited(base, max(1, length * share // 1000), rng) for share in (4, 12, 20, 23, 27, 40, 80)]
    rng.shuffle(rows)
    return [(i, " ".join(r), "a") for i, r in enumerate(rows)]


def test_pipeline_stage_finds_what_brute_force_finds(make_docs):
    rows = planted()
    wanted = {c for _, c in brute_jaccard([r[:2] for r in rows])}
    out = dict(corpus_pipeline.STAGES)["near_dedup"](None, make_docs(rows), "")
    assert {r.doc_id for r in out.collect()} == wanted and len(wanted) < len(rows) - 75


def test_pipeline_stage_goes_through_simhash(make_docs, monkeypatch):
    """Without the bands the fingerprints of five-word shingles alone join light edits, and the exact check still parts what is linked but not similar."""
    monkeypatch.setattr(jaccard, "bands", lambda hashes: np.empty(0, np.uint64))
    rng = random.Random(14)
    rows = []
    for i in range(0, 60, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(600)]
        rows += [(i, " ".join(base), "a"), (i + 1, " ".join(edited(base, 1, rng)), "a")]
    near = brute_jaccard([r[:2] for r in rows])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = {r.doc_id for r in stage(None, make_docs(rows), "").collect()}
    assert {c for _, c in near} == set(range(0, 60, 2)) and set(range(0, 60, 2)) <= left and len(left) < 36
    monkeypatch.setattr(jaccard, "fingerprint", lambda text, words: 7)
    assert {r.doc_id for r in stage(None, make_docs(rows[::2]), "").collect()} == set(range(0, 60, 2))


def test_a_group_through_its_middle(make_docs):
    """Copies that are similar to one text but not to each other, among many that are not similar at all but share most words."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "a")] + [(i, " ".join(edited(base, 4, rng)), "a") for i in range(1, 40)] + [(i, " ".join(edited(base, 16, rng)), "a") for i in range(40, 60)]
    got = sorted((r.doc_id, r.component_id) for r in near_copies(make_docs(rows)).collect())
    assert got == sorted(brute_jaccard([r[:2] for r in rows]))


def template(n):
    """Texts of 40 words, of which two are changed: most share bands, hardly any two are similar."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    return [(i, " ".join(edited(base, 2, rng)), "a") for i in range(n)]


def test_pairs_checked_grow_with_the_rows(make_docs, monkeypatch):
    counted = []
    check = jaccard._checked

    def counting(pairs, sets, similarity):
        counted[-1] += pairs.count()
        return check(pairs, sets, similarity)

    monkeypatch.setattr(jaccard, "_checked", counting)
    for n in (250, 500, 1000):
        counted.append(0)
        rows = template(n)
        got = sorted((r.doc_id, r.component_id) for r in near_copies(make_docs(rows)).collect())
        assert n > 250 or got == sorted(brute_jaccard([r[:2] for r in rows]))
    assert counted[1] < 3 * counted[0] and counted[2] < 3 * counted[1] and counted[2] < 20_000


def test_prefix_pairs_hold_all_similar_pairs(spark):
    """Against all pairs of random sets that overlap much, of different sizes, in several components."""
    rng = random.Random(13)
    sets = {}
    for i in range(160):
        base = range((i % 4) * 1000, (i % 4) * 1000 + rng.choice([20, 30, 33, 40]))
        sets[i] = sorted({x if rng.random() > rng.choice([0, 0.03, 0.1]) else rng.randrange(10**6, 10**6 + 60) for x in base})
    roots = {i: i if rng.random() < 0.5 else i % 4 for i in sets}
    rooted = spark.createDataFrame([(i, len(s), roots[i]) for i, s in sets.items()], "digest long, size long, root long")
    table = spark.createDataFrame(list(sets.items()), "digest long, hashes array<long>")
    got = {(r.a, r.b) for r in jaccard.prefix_pairs(rooted, table, 0.8).collect()}
    wanted = {(i, j) for i in sets for j in sets if i < j and roots[i] != roots[j] and (n := len(set(sets[i]) & set(sets[j]))) / (len(sets[i]) + len(sets[j]) - n) >= 0.8}
    assert wanted <= got and len(wanted) > 300 and all(roots[a] != roots[b] for a, b in got)


def test_hard_rows(hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    got = near_copies(hard_docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(brute_jaccard(rows), key=str)
    assert near_copies(hard_docs.limit(0)).count() == 0 and drop_similar_copies(hard_docs).columns == hard_docs.columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted((r.doc_id, r.component_id) for r in near_copies(docs).collect())
    assert got == sorted(brute_jaccard([(r.doc_id, r.text) for r in docs.collect()]))
