import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm.ordered import SUM, XOR, running
from wattframe.llm.prefixes import BLOCK, conversation_trie, rebuilt_turns, sequence_blocks, sorted_parts, trie_nodes, turn_keys

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rebuilt):
    """rebuilt: conversation to its list of (role, text). All nodes by plain dictionaries."""
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items() if c is not None}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        start = c - int(np.fmod(c, 20))
        out[c] = turns.get(start, [])[:h] + mine[h:]
    return out


def as_turns(spark, rebuilt):
    rows = [(c, d, r, t) for c, turns in rebuilt.items() for d, (r, t) in enumerate(turns, 1)] + [(c, None, "", "") for c in rebuilt]
    return turn_keys(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("turn", "depth")


def grown(seed, n=90):
    """Random conversations: few different turns, copies, prefixes of others, some over several blocks, some empty."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, 2)))
    out = {}
    for c in range(-5, n):
        kind = rng.random()
        if out and kind < 0.5:
            base = rng.choice(list(out.values()))
            out[c] = base[:rng.randint(0, len(base))] + [turn() for _ in range(rng.randint(0, 3))]
        elif out and kind < 0.65:
            out[c] = list(rng.choice(list(out.values())))
        elif kind < 0.72:
            out[c] = [turn() for _ in range(rng.choice([BLOCK, 2 * BLOCK, 2 * BLOCK + 5, 3 * BLOCK + 1]))]
        else:
            out[c] = [turn() for _ in range(rng.randint(0, 5))]
    return out


@pytest.mark.parametrize(("seed", "part_rows"), [(1, 50_000), (2, 5), (3, 2), (4, 11), (5, 1)])
def test_forests_merge_to_the_trie(spark, seed, part_rows):
    rebuilt = grown(seed)
    turns = as_turns(spark, rebuilt)
    assert rows_of(trie_nodes(turns, part_rows)) == brute(rebuilt)
    if part_rows < 10:
        assert sorted_parts(sequence_blocks(turns), part_rows).select("part").distinct().count() > 8


def test_copies_over_many_parts(spark):
    """A third of all conversations are copies, another third begin alike."""
    rebuilt = {c: [("user", "a b"), ("assistant", "c"), ("user", "d")] if c % 3 == 0 else [("user", "a b"), ("assistant", "c"), ("user", f"e{c}")] if c % 3 == 1 else [("user", str(c))] for c in range(300)}
    assert rows_of(trie_nodes(as_turns(spark, rebuilt), 20)) == brute(rebuilt)


def test_rebuilt_turns(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "x", "y z", "\ta\x0bb "])) for c in [None, -41, -40, -7, *range(70)] for _ in range(rng.randint(1, 6))]
    rows += [(c, 0, "user", "alone") for c in range(101, 112)] + [(65, 0, "user", "long text " * 20_000), (20, 1, "user", "same"), (20, 1, "user", "same"), (21, 1, "user", "same")]
    table = spark.createDataFrame([(*r, 1, "t", "k") for r in rows], SCHEMA + ", depth int, t string, K1 string")
    rebuilt = rebuild(rows)
    found = defaultdict(list)
    for r in rebuilt_turns(table).collect():
        found[r.conv_id] += [(r.depth, r.t)] if r.depth else []
    keys = {c: [(d, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()) for d, (r, t) in enumerate(turns, 1)] for c, turns in rebuilt.items()}
    assert {c: sorted(x) for c, x in found.items()} == keys and any(not x for x in keys.values())
    assert rows_of(conversation_trie(table, part_rows=7)) == brute(rebuilt)
    assert conversation_trie(table.limit(0)).count() == 0 and conversation_trie(table.where("conv_id IS NULL")).count() == 0


def test_running_along_a_key_that_holds_nearly_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.when(F.col("id") % 40 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("k"), F.col("id").alias("o"), (F.col("id") * 31 % 17).alias("v"))
        for down in (False, True):
            got = {(r.k, r.o): (r.s, r.x) for r in running(rows, "k", ["o"], {"s": ("v", SUM), "x": ("v", XOR)}, down).collect()}
            total, mixed = defaultdict(int), defaultdict(int)
            for o in sorted(range(20_000), reverse=down):
                k = None if o % 40 == 0 else 7
                total[k] += o * 31 % 17
                mixed[k] ^= o * 31 % 17
                assert got[k, o] == (total[k], mixed[k])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
