import hashlib
import random
import re

from wattframe.llm.infill import MARKS, arrange, cut, fill_in_middle, infill_digests, invert, read_pieces, restore_texts, token_ends

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(3)
    parts = ["a", "é𝄞", " ", "\t\n", "<", "P>", "<M", "wort", "\x0b", "<S", ">", " "]
    made = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), "a") for i in range(600)]
    return made + [(700, "x <P> y", "a"), (701, None, "a"), (None, "null id here", "a"), (-5, "below zero now", None), (3, "again and again", "a"), (3, "again and again", "a"), (900, "lang " * 50_000, "a")]


def test_forms_and_outputs_equal_the_definition(make_docs):
    wanted = rows()
    found = fill_in_middle(make_docs(wanted)).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr)
    assert got == sorted(((i, *naive(i, t)) for i, t, _ in wanted), key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and all(r.output_sha256 == sha(r.output) for r in found)
    texts = {}
    for i, t, _ in wanted:
        texts.setdefault(i, []).append(t or "")
    for r in found:
        source = texts[r.doc_id][0].encode()
        table = [(p.buffer, p.start, p.length) for p in r.pieces]
        assert len(texts[r.doc_id]) > 1 or b"".join(read_pieces(table, source)).decode() == r.output


def test_restored_from_output_and_form(make_docs):
    wanted = rows()
    back = restore_texts(fill_in_middle(make_docs(wanted)).drop("pieces")).collect()
    assert sorted(((r.doc_id, r.text, r.restored_sha256) for r in back), key=repr) == sorted(((i, t or "", sha(t or "")) for i, t, _ in wanted), key=repr)


def test_cuts_and_permutations():
    text = "ab <S é".encode()
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            parts = cut(cut([(0, 0, len(text))], a), b)
            assert [length for _, _, length in parts] == [a, b - a, len(text) - b]
            for form in ("psm", "spm"):
                output = b"".join(read_pieces(arrange(parts, form), text))
                assert b"".join(read_pieces(invert(output, form), output)) == text and len(output) == len(text) + sum(map(len, MARKS.values()))
    assert token_ends(b"").tolist() == [] and token_ends(b"  ").tolist() == [2] and token_ends(b" a b ").tolist() == [2, 4, 5]


def test_hard_rows(hard_docs):
    found = infill_digests(hard_docs).collect()
    assert sorted((str(r.doc_id), r.restored_sha256) for r in found) == sorted((str(r.doc_id), sha(r.text or "")) for r in hard_docs.collect())
    assert infill_digests(hard_docs.limit(0)).count() == 0
