import hashlib
import random
import re

from wattframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = (re.compile(p) for p in (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def naive(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_strict_spans_equal_the_patterns():
    rng = random.Random(1)
    for alphabet in ("a1@.@-+ (2)34.5 6%é\n", "0123456789 -", "a.@"):
        for _ in range(20_000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == naive(t), t


def test_hard_rows(hard_docs, make_docs):
    got = pii.find_pii(hard_docs).collect()
    assert len(got) == hard_docs.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_pii(hard_docs.limit(0)).count() == 0
    docs = make_docs([(1, "é𝄞 mail a.b@c.org, 10.0.0.1 and 4111 1111 1111 1111 or +1 (234) 555-1234 x", "a")])
    row = pii.find_pii(docs).first()
    wanted = pii.listed(naive(docs.first().text))
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and row.spans == wanted and row.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()


def test_contexts_discover_and_random_text_does_not(make_docs):
    rng = random.Random(2)
    seeds = [(i, f"please write to user{i}@host{i}.org for details", "a") for i in range(12)]
    hidden = [(100, "please write to user77[at]host for details", "a"), (101, "nothing about user78[at]host for once", "a")]
    noise = [(200 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "12345678", "v1.2.3", "2024-01-01"]) for _ in range(60)), "b") for i in range(30)]
    got = {r.doc_id: r for r in pii.find_pii(make_docs(seeds + hidden + noise)).collect()}
    assert got[100].n_found == 1 and got[100].spans == "email:16:30" and got[100].n_email == 0
    assert sum(r.n_found for r in got.values()) == 1
    masked = {r.doc_id: r for r in pii.mask_pii(make_docs(seeds + hidden)).collect()}
    assert masked[100].text == "please write to [EMAIL] for details" == masked[3].text and masked[100].n_chars == len(masked[100].text)


def test_mask_keeps_rows(hard_docs):
    out = pii.mask_pii(hard_docs)
    assert out.columns == hard_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, hard_docs.collect()))
    assert pii.mask("ab cd ef", [(0, 3, 8), (1, 3, 5), (2, 0, 2)]) == "[CARD] [EMAIL]"
