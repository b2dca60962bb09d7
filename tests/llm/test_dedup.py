import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wattframe.llm import dedup
from wattframe.llm.dedup import build_index, drop_copies, exact_dedup, grow_directory

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_hard_rows(hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    for entries in (1, 2, 1000):
        assert sorted(map(tuple, exact_dedup(hard_docs, bucket_entries=entries).collect()), key=str) == brute(rows)


def test_empty(hard_docs):
    assert exact_dedup(hard_docs.limit(0)).count() == 0 and drop_copies(hard_docs.limit(0)).columns == hard_docs.columns


def test_split_keeps_every_entry_in_order(make_docs):
    docs = make_docs([(i, f"text {i % 40}", "a") for i in range(200)])
    index = build_index(docs, bucket_entries=3, max_depth=6).entries
    assert index.count() == 40 and index.select("bucket").distinct().count() > 8
    assert {r.keep_id for r in index.collect()} == set(range(160, 200)) and {r.group_size for r in index.collect()} == {5}


def test_directory_doubles_only_where_full():
    directory = grow_directory({0: 10, 1: 1, 7: 1}, 4, 3)
    assert directory.depth == 3 and directory.slots == (0, 1, 2, 2, 3, 3, 3, 3)
    assert grow_directory({}, 4, 3).slots == (0,)


def test_stage_keeps_columns_and_one_of_each(hard_docs):
    kept = drop_copies(hard_docs)
    assert kept.columns == hard_docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 6, 7, 8, 9]


def test_stage_agrees_with_the_marks(make_docs):
    docs = make_docs([(7, "A", "a"), (7, "B", "a"), (9, "a", "a"), (None, "a", "a"), (None, "c", "a")])
    marked = sorted(((r.doc_id, r.text_sha256) for r in exact_dedup(docs).where("kept").collect()), key=str)
    stay = sorted(((r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in drop_copies(docs).collect()), key=str)
    assert marked == stay and len(stay) == 3


@pytest.mark.parametrize("keys", [1, 3, 7])
def test_owners_tell_texts_of_one_hash_apart(make_docs, keys):
    """A hash with a handful of values: nearly every text collides, and the chains hold them all."""
    poor = lambda text: F.shiftleft(F.pmod(F.xxhash64(text), F.lit(keys)), 61)
    rows = [(i, f"Text {i % 25}" if i % 4 else None, "a") for i in range(160)]
    docs = make_docs(rows)
    index = build_index(docs, bucket_entries=2, max_depth=4, hashed=poor).entries.collect()
    chains = defaultdict(list)
    for r in index:
        chains[(r.bucket, r.h)].append((r.link, bytes(r.sha)))
    assert len(index) == 26 and len(chains) <= keys
    assert all([link for link, _ in sorted(c)] == list(range(1, len(c) + 1)) and sorted(sha for _, sha in c) == [sha for _, sha in sorted(c)] for c in chains.values())
    assert sorted(map(tuple, exact_dedup(docs, bucket_entries=2, max_depth=4, hashed=poor).collect()), key=str) == brute([r[:2] for r in rows])


def test_probes_go_through_the_directory(make_docs):
    """With a directory other than the one that placed the entries, probes reach the wrong buckets and find next to nothing."""
    docs = make_docs([(i, f"text {i}", "a") for i in range(64)])
    index = build_index(docs, bucket_entries=2, max_depth=6)
    rows = dedup.keyed(docs, "doc_id", "text", F.xxhash64).select("doc_id", "h", F.unhex(F.sha2("normal", 256)).alias("sha"))
    ask = lambda i: i.find(F.col("h"), F.col("sha"), rows).count()
    assert index.directory.depth > 2 and ask(index) == 64
    wrong = dedup.Directory(index.directory.depth, tuple(reversed(index.directory.slots)))
    assert ask(dedup.Index(wrong, index.entries)) < 16
