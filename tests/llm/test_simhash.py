import random

import numpy as np
import xxhash

from wattframe.llm.components import connected_components
from wattframe.llm.simhash import drop_near_copies, fingerprint, link_buckets, link_fingerprints, near_dedup


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, distance=4):
    """fps: (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, least.get(find(i))) for i, (doc, _) in enumerate(fps)]


def test_fingerprints():
    for text in ("", " \n", "one", "A b C", "a b c d", "É ä\x85x y z w", "w " * 70_000, "n " + "a b c d e f g " * 50):
        assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_hard_rows(hard_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in hard_docs.collect()]
    got = near_dedup(hard_docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)
    assert sorted(r.fingerprint for r in got) == sorted(f"{f:016x}" for _, f in rows)
    assert near_dedup(hard_docs.limit(0)).count() == 0 and drop_near_copies(hard_docs).columns == hard_docs.columns


def test_links_lose_no_component(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(link_fingerprints(df)).collect()}
    groups = {}
    for x in signed:
        groups.setdefault(roots.get(x, x), set()).add(x)
    wanted = {}
    for i, c in brute_components(list(enumerate(fps))):
        wanted.setdefault(c, set()).add(signed[i])
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in wanted.values()}


def test_a_large_bucket_gives_few_links():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    probe = (np.arange(len(fp)) % 3 == 0).astype(np.int8)
    order = np.argsort(probe, kind="stable")
    a, b = link_buckets(np.zeros(len(fp), np.int64), probe[order], fp[order], 4)
    assert len(fp) - 1 <= len(a) <= 2 * len(fp) and (np.bitwise_count(a ^ b) <= 4).all()


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
