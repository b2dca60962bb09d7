"""Prefix trie of conversations: union-find over the longest common prefixes of sorted neighbours, partition by partition."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.ordered import SUM, XOR, running
from wattframe.session import cut_lineage

SHARE = 20  # conversations c and c - c % SHARE begin alike
MOST = 4  # with less than MOST turns
BLOCK = 16  # turns of a sort key; a longer conversation goes on in a further block below the node where the last one ended
PART_ROWS = 50_000  # sequences of a partition forest
_HEX = 32
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = (
    "part int, depth long, k1 long, k2 long, conv_id long, parent_conv_id long, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "ids string"
)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t (128-bit digest of role and text, hex), words; rows without conv_id belong to no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    ).where("conv_id IS NOT NULL")


def borrowed(conv_id: Column) -> Column:
    """Number of turns that a conversation takes over."""
    return F.crc32(conv_id.cast("string")) % MOST


def rebuilt_turns(conversations: DataFrame, share: int = SHARE) -> DataFrame:
    """conv_id, depth (from 1; null in a row that only says that the conversation exists), t, words: the first h turns of conversation c - c % share, then c's own after its first h.

    One pass along each conversation numbers its turns with the borrowed ones before them, so nothing is joined to the turns of a long conversation.
    """
    own = turn_keys(conversations)
    heads = own.where(F.col("conv_id") % share == 0).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t"))).where(F.col("at") < MOST)
    ids = own.select("conv_id").distinct()
    donor = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % share).alias("_donor"), borrowed(F.col("conv_id")).alias("_h"))
    given = donor.join(heads.withColumnRenamed("conv_id", "_from"), (F.col("_donor") == F.col("_from")) & (F.col("at") <= F.col("_h")))
    rows = own.select("conv_id", F.lit(1).cast("long").alias("own"), "turn", "t", "words").unionByName(
        given.select("conv_id", F.lit(0).cast("long").alias("own"), F.col("at").cast("long").alias("turn"), "t", "words")
    ).withColumn("one", F.lit(1).cast("long"))
    numbered = running(rows, "conv_id", ["own", "turn", "t"], {"position": ("one", SUM), "own_position": ("own", SUM)})
    h = borrowed(F.col("conv_id"))
    depth = F.when(F.col("own") == 0, F.col("position")).when(F.col("own_position") > h, F.col("position") - h)
    listed = numbered.select("conv_id", depth.alias("depth"), "t", "words", "own", "own_position")
    return listed.where("depth IS NOT NULL OR (own = 1 AND own_position = 1)").select("conv_id", "depth", "t", "words")


def sequence_blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, seq (turn digests), words, r1, r2 (digest of all blocks before), n1, n2 (of these and this one), stays (1 if the conversation goes on).

    Every conversation has a block 0. Only conversations with a full block take part in the passes along their blocks.
    """
    block = F.coalesce(F.floor((F.col("depth") - 1) / BLOCK), F.lit(0)).cast("long")
    listed = F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("depth", "t", "words"))))
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(listed.alias("_l")).select(
        "conv_id", "block", F.array_join(F.transform("_l", lambda x: x["t"]), "").alias("seq"), F.transform("_l", lambda x: x["words"].cast("long")).alias("words")
    )
    blocks = cut_lineage(blocks)
    zero = F.lit(0).cast("long")
    full = (F.col("block") > 0) | (F.length("seq") == BLOCK * _HEX)
    alone = blocks.where(~full).select("*", *[zero.alias(c) for c in ("r1", "r2", "n1", "n2", "stays")])
    linked = blocks.where(full).withColumns({"x1": F.xxhash64("block", "seq"), "x2": F.xxhash64(F.lit("second"), "seq", "block"), "one": F.lit(1).cast("long")})
    linked = running(linked, "conv_id", ["block"], {"n1": ("x1", XOR), "n2": ("x2", XOR)})
    linked = running(linked, "conv_id", ["block"], {"left": ("one", SUM)}, descending=True)
    return alone.unionByName(linked.select(
        "conv_id", "block", "seq", "words", F.col("n1").bitwiseXOR(F.col("x1")).alias("r1"), F.col("n2").bitwiseXOR(F.col("x2")).alias("r2"), "n1", "n2",
        (F.col("left") > 1).cast("long").alias("stays"),
    ))


_ORDER = ("block", "r1", "r2", "seq", "stays", "conv_id")
_EDGE = ("block", "r1", "r2", "seq")


def sorted_parts(blocks: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The blocks with `part`: ranges of about `part_rows` sequences in their order. The conversation is the last part of the order, so copies are split too."""
    blocks = cut_lineage(blocks)
    parts = max(1, -(-blocks.count() // part_rows))
    return cut_lineage(blocks.repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id()))


def part_edges(rows: DataFrame) -> DataFrame:
    """part, before (last sequence of the part before), after (first sequence of the part after): one row per part."""
    key = F.struct(*_EDGE)
    ends = rows.groupBy("part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    along = Window.orderBy("part")
    return ends.select("part", F.lag("_last").over(along).alias("before"), F.lead("_first").over(along).alias("after"))


@dataclass
class Sequences:
    """Sorted sequences of a part; `common[i]` turns are shared with the sequence before, -1 if the blocks hang below other nodes. common[m] belongs to the next part's first."""

    block: np.ndarray
    roots: np.ndarray  # r1, r2
    ends: np.ndarray  # n1, n2
    conv: np.ndarray
    stays: np.ndarray
    seq: list[bytes]
    length: np.ndarray
    common: np.ndarray
    words: np.ndarray  # running sums of words, from offset[i] on, 0 first
    offset: np.ndarray
    saved_below: np.ndarray
    leaves_below: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        """1 where a sequence ends its conversation at a childless node; of copies, for the last."""
        return ((self.stays == 0) & (self.common[1:] < self.length)).astype(np.int64)

    def words_to(self, rows: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Words in the first `turns` turns of the block."""
        return self.words[self.offset[rows] + np.maximum(turns, 0)]


def _shared(a: tuple | None, b: tuple) -> int:
    if a is None or a[:3] != b[:3]:
        return -1
    n = 0
    while n < min(len(a[3]), len(b[3])) // _HEX and a[3][n * _HEX:(n + 1) * _HEX] == b[3][n * _HEX:(n + 1) * _HEX]:
        n += 1
    return n


def read_sequences(table: pa.Table, edge: pa.Table) -> Sequences:
    table = table.sort_by([(c, "ascending") for c in _ORDER])
    column = lambda name: table.column(name).to_numpy()
    seq = [s.encode() for s in table.column("seq").to_pylist()]
    length = np.array([len(s) // _HEX for s in seq], dtype=np.int64)
    block, roots = column("block"), np.stack([column("r1"), column("r2")], axis=1)
    cells = np.array(seq, dtype=f"S{BLOCK * _HEX}").view(f"S{_HEX}").reshape(len(seq), BLOCK)
    equal = np.cumprod(cells[1:] == cells[:-1], axis=1).sum(axis=1)
    inner = np.minimum(equal, np.minimum(length[1:], length[:-1]))
    inner[(block[1:] != block[:-1]) | (roots[1:] != roots[:-1]).any(axis=1)] = -1
    outer = [edge.column(c).to_pylist()[0] for c in ("before", "after")]
    outer = [None if e is None else (e["block"], e["r1"], e["r2"], e["seq"].encode()) for e in outer]
    here = lambda i: (int(block[i]), int(roots[i, 0]), int(roots[i, 1]), seq[i])
    common = np.concatenate([[_shared(outer[0], here(0))], inner, [_shared(outer[1], here(-1))]]).astype(np.int64)
    words = table.column("words").combine_chunks().flatten().to_numpy()
    sums = np.concatenate([[0], np.cumsum(words)])
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    offset = starts + np.arange(len(seq))
    at = np.arange(len(words) + len(seq))
    row = np.repeat(np.arange(len(seq)), length + 1)
    running_words = sums[at - row] - sums[starts[row]]
    below = [column(c) if c in table.column_names else np.zeros(len(seq), np.int64) for c in ("saved_below", "leaves_below")]
    return Sequences(block, roots, np.stack([column("n1"), column("n2")], axis=1), column("conv_id"), column("stays"), seq, length, common, running_words, offset, *below)


@dataclass
class Forest:
    """Branching and ending nodes of a part, each with the chain of single-child nodes up to below its parent."""

    hi: np.ndarray  # depth in the block
    first: np.ndarray  # sequences first..last pass through the node
    last: np.ndarray
    least: np.ndarray  # smallest conversation
    children: np.ndarray
    parent: np.ndarray  # -1 at the top of a block's subtree
    at: np.ndarray  # node at the end of each sequence


def grow_forest(s: Sequences) -> Forest:
    """Joins neighbours by their common prefixes, deepest first: a merge of two components makes a branching node, or extends one of the same depth."""
    m = len(s.length)
    hi, first, last = s.length.tolist(), list(range(m)), list(range(m))
    least, children, parent = s.conv.tolist(), [0] * m, [-1] * m
    joined = list(range(m))  # union-find over sequences; the root of a component is its leftmost sequence
    node = list(range(m))  # top node of a component, at its root
    at = list(range(m))

    def find(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    inner = s.common[1:m]
    order = np.argsort(-inner, kind="stable")
    for i in (order[inner[order] >= 0] + 1).tolist():
        depth = int(s.common[i])
        left, right = find(i - 1), find(i)
        a, b = node[left], node[right]
        if hi[a] == depth:
            top = a
            if hi[b] == depth:  # a sequence that ends at the same node
                at[b], hi[b] = a, -1
            else:
                parent[b] = a
                children[a] += 1
        elif hi[b] == depth:
            top, parent[a] = b, b
            children[b] += 1
        else:
            top = len(hi)
            parent[a] = parent[b] = top
            hi.append(depth)
            first.append(0)
            last.append(0)
            least.append(least[a])
            children.append(2)
            parent.append(-1)
        first[top], last[top], least[top] = first[a], last[b], min(least[a], least[b], least[top])
        joined[right] = left
        node[left] = top
    return Forest(*(np.array(x, dtype=np.int64) for x in (hi, first, last, least, children, parent, at)))


def part_shares(table: pa.Table, edge: pa.Table) -> pa.Table:
    """Of the blocks below block 0: words of turns that an earlier sequence holds too, and whether the sequence ends at a leaf it stands for."""
    s = read_sequences(table, edge)
    rows = np.arange(len(s.length))
    shared = s.words_to(rows, s.common[:-1])
    below = s.block > 0
    return pa.table({"conv_id": s.conv[below], "block": s.block[below], "shared": shared[below], "leaf": s.leaf[below]})


def part_nodes(table: pa.Table, edge: pa.Table) -> pa.Table:
    """All nodes of a part's forest, one row each.

    A node whose sequences all lie inside the part is complete. The others lie on the part's first or last path; they, and the nodes where a block ends, carry a key, by which their counts
    are added to those of other parts. Every column but the smallest conversation is a sum over sequences: a child, a leaf or a repeated word is counted at one sequence, that
    which differs from its neighbour there.
    """
    part = table.column("part")[0].as_py()
    s = read_sequences(table, edge)
    f = grow_forest(s)
    m = len(s.length)
    alive = np.flatnonzero(f.hi >= 0)
    lo = np.where(f.parent[alive] >= 0, f.hi[f.parent[alive]] + 1, 0)
    count = f.hi[alive] - lo + 1
    node = np.repeat(alive, count)
    depth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    top = depth == np.repeat(lo, count)
    hi, first, last = f.hi[node], f.first[node], f.last[node]
    before, after = int(s.common[0]), int(s.common[m])
    is_open = lambda a, b, d: ((a == 0) & (before >= d)) | ((b == m - 1) & (after >= d))
    block = s.block[first]
    entry = (block > 0) & (depth == 0)  # the node where the block before ended: only children are counted here

    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    rows = np.arange(m)
    leaf, saved = sums(s.leaf + s.leaves_below), sums(s.words_to(rows, s.common[:-1]))
    saved_below = sums(s.saved_below)
    children = np.where(depth == hi, f.children[node], 1) - ((first == 0) & (before > depth))
    above = s.words_to(first, depth - 1)
    tokens = saved[last + 1] - saved[first + 1] - (last - first) * above + saved_below[last + 1] - saved_below[first]
    head = (first == 0) & (before >= depth)
    tokens = tokens + np.where(head, s.words_to(np.zeros(1, np.int64), np.array([before]))[0] - above, 0)

    up = np.where(top, f.parent[node], node)
    up_first, up_last = np.where(up >= 0, f.first[up], 0), np.where(up >= 0, f.last[up], 0)
    members: dict[int, list[int]] = {}
    for i in np.flatnonzero(s.stays == 0).tolist():
        members.setdefault(int(f.at[i]), []).append(i)

    node_open = is_open(first, last, depth)
    keyed = node_open | (depth == BLOCK) | entry
    below_entry = (block > 0) & (depth == 1)
    asks = ((depth > 0) & is_open(up_first, up_last, depth - 1)) | below_entry
    known = (depth > 0) & ~asks
    keys: dict[tuple[int, int], tuple[int, int]] = {}

    def key(row: int, d: int) -> tuple[int, int]:
        """Digest that names the node after `d` turns of a sequence's block."""
        if d == 0:
            return int(s.roots[row, 0]), int(s.roots[row, 1])
        if d == BLOCK:
            return int(s.ends[row, 0]), int(s.ends[row, 1])
        if (row, d) not in keys:
            digest = hashlib.blake2b(s.roots[row].tobytes() + s.seq[row][:d * _HEX], digest_size=16).digest()
            keys[row, d] = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
        return keys[row, d]

    def key_columns(wanted: np.ndarray, at_rows: np.ndarray, depths: np.ndarray) -> list[pa.Array]:
        found = np.zeros((len(wanted), 2), dtype=np.int64)
        for i in np.flatnonzero(wanted).tolist():
            found[i] = key(int(at_rows[i]), int(depths[i]))
        return [pa.array(found[:, c], mask=~wanted) for c in (0, 1)]

    digests: list[str | None] = [_NONE] * len(node)
    ids: list[str | None] = [None] * len(node)
    for i in np.flatnonzero(depth == hi).tolist():
        listed = members.get(int(node[i]))
        if listed:
            text = ",".join(map(str, s.conv[listed].tolist()))
            if keyed[i]:
                ids[i] = text
            else:
                digests[i] = hashlib.sha256(text.encode()).hexdigest()
    zero = lambda x: np.where(entry, 0, x)
    parent_least = np.where(up >= 0, f.least[up], 0)
    return pa.table({
        "part": np.full(len(node), part, np.int32), "depth": block * BLOCK + depth, **dict(zip(("k1", "k2"), key_columns(keyed, first, depth))),
        "conv_id": pa.array(f.least[node], mask=entry), "parent_conv_id": pa.array(parent_least, mask=~known), **dict(zip(("p1", "p2"), key_columns(asks, np.where(asks & ~below_entry, up_first, first), depth - 1))),
        "n_convs": zero(last - first + 1), "n_children": children, "n_leaves": zero(leaf[last + 1] - leaf[first]), "saved_tokens": zero(tokens),
        "ends_sha256": pa.array(digests, pa.string()), "ids": pa.array(ids, pa.string()),
    })


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest) of the conversations that end at the keyed nodes, whose ids stand in ascending order part by part."""
    def stream(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for *now, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            yield _digest_rows(out)
            out = []
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    listed = nodes.where("ids IS NOT NULL").select("depth", "k1", "k2", "part", "ids").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "part")
    return listed.mapInArrow(stream, "depth long, k1 long, k2 long, digest string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def trie_nodes(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per node of the trie of all conversations in `turns` (conv_id, depth from 1, t, words; a null depth names a conversation).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Sequences are sorted by range; each part joins its neighbours by
    union-find and gives its forest. The forests are contracted to what touches a part's edges and merged by the keys of those nodes. Long conversations are cut into blocks of
    BLOCK turns, so no row grows with a conversation; what hangs below a block is added along the conversation.
    """
    rows = sorted_parts(sequence_blocks(turns), part_rows)
    edges = cut_lineage(part_edges(rows))
    grouped = edges.groupBy("part")
    deep = rows.where("block > 0").select("part").distinct()
    shares = rows.join(deep, "part", "left_semi").groupBy("part").cogroup(edges.join(deep, "part", "left_semi").groupBy("part")).applyInArrow(
        part_shares, "conv_id long, block long, shared long, leaf long"
    )
    below = running(shares, "conv_id", ["block"], {"saved_below": ("shared", SUM), "leaves_below": ("leaf", SUM)}, descending=True)
    below = below.select("conv_id", (F.col("block") - 1).alias("block"), "saved_below", "leaves_below")
    none = F.lit(0).cast("long")
    weighted = rows.where("stays = 0").withColumns({"saved_below": none, "leaves_below": none}).unionByName(rows.where("stays = 1").join(below, ["conv_id", "block"]))
    nodes = cut_lineage(weighted.groupBy("part").cogroup(grouped).applyInArrow(part_nodes, _NODE))

    keyed = nodes.where("k1 IS NOT NULL").groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max(F.when(F.col("p1").isNotNull(), F.struct("p1", "p2"))).alias("p"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = cut_lineage(keyed.join(_end_digests(nodes), ["depth", "k1", "k2"], "left").select(
        "depth", "k1", "k2", "conv_id", "parent_conv_id", F.col("p.p1").alias("p1"), F.col("p.p2").alias("p2"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(_NONE)).alias("ends_sha256"),
    ))
    named = merged.select(F.col("depth").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv_id").alias("_conv"))
    up = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    # A part asks once for each parent outside; so a node with very many children is no hot key.
    inside = nodes.where("k1 IS NULL")
    asked = inside.where("p1 IS NOT NULL").select("part", "depth", "p1", "p2").distinct().join(named, up).select("part", "depth", "p1", "p2", "_conv")
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    unknown = F.lit(None).cast("long").alias("_conv")
    return inside.where("p1 IS NULL").select("*", unknown).select(*columns).unionByName(
        inside.where("p1 IS NOT NULL").join(asked, ["part", "depth", "p1", "p2"]).select(*columns)
    ).unionByName(merged.join(named, up, "left").select(*columns))


def conversation_trie(conversations: DataFrame, share: int = SHARE, part_rows: int = PART_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations (see rebuilt_turns, trie_nodes).

    Turns go by turn number, nulls first, ties by the digest of role and text; null roles and texts become empty; repeated rows are repeated turns. Rows without conv_id belong to no
    conversation. An empty table has no nodes. Other columns are not read.
    """
    return trie_nodes(rebuilt_turns(conversations, share), part_rows)


_TURN = "md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda crc, byte: "
    "list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)
ORACLE_SQL = rf"""
WITH s AS (SELECT conv_id, {_TURN} AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % {MOST} AS h FROM (SELECT DISTINCT conv_id FROM s)),
u AS (SELECT c.conv_id, 0 AS own, place, t, words FROM c JOIN s ON s.conv_id = c.conv_id - c.conv_id % {SHARE} AND place <= h
      UNION ALL SELECT s.conv_id, 1, place, t, words FROM s JOIN c ON s.conv_id = c.conv_id AND place > h),
r AS (SELECT conv_id, t, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM u),
p AS (SELECT conv_id, depth, words, md5(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, count(*) OVER (PARTITION BY conv_id) AS size FROM r
      UNION ALL SELECT c.conv_id, 0, 0, 'root', (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
      sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY depth, k),
l AS (SELECT p.*, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
g AS (SELECT depth - 1 AS depth, up AS k, count(DISTINCT l.k) AS n_children FROM l WHERE depth > 0 GROUP BY depth, up),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g USING (depth, k)),
o AS (SELECT p.conv_id, p.depth, p.k, CASE WHEN w.conv_id = p.conv_id THEN (w.n_convs - 1) * w.words ELSE 0 END AS saved, CASE WHEN w.conv_id = p.conv_id AND w.n_children = 0 THEN 1 ELSE 0 END AS leaf
      FROM p JOIN w USING (depth, k)),
b AS (SELECT depth, k, sum(saved) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS saved, sum(leaf) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS leaf FROM o),
t AS (SELECT depth, k, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM b GROUP BY depth, k),
up AS (SELECT DISTINCT l.depth, l.k, w.conv_id AS parent_conv_id FROM l LEFT JOIN w ON w.depth = l.depth - 1 AND w.k = l.up)
SELECT w.conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
FROM w JOIN t USING (depth, k) JOIN up USING (depth, k)
"""
