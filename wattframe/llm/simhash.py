"""SimHash fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.components import connected_components
from wattframe.llm.text import fresh, record_batches, texts_of
from wattframe.session import cut_lineage

SHINGLE_WORDS = 4
DISTANCE = 4
SEGMENTS = 3
_SHINGLES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 21
_ONE = np.uint64(1)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64 hashes (seed 42). No words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[at:at + _SHINGLES_AT_ONCE], last[at:at + _SHINGLES_AT_ONCE])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (64 bits as long), one row per row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(batch: pa.RecordBatch) -> list:
        fps = np.array([fingerprint(t, words) for t in texts_of(batch.column(1))], dtype=np.uint64)
        return [batch.column(0), fps.view(np.int64)]

    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: record_batches(batches, make, schema), "doc_id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _balls(width: int, radius: int) -> np.ndarray:
    """All masks of up to `radius` bits of `width`, the empty one first."""
    masks, layer = [0], [0]
    for _ in range(radius):
        layer = sorted({m | 1 << b for m in layer for b in range(width) if not m >> b & 1})
        masks += layer
    return np.array(masks, dtype=np.uint64)


def bucket_rows(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(bucket, probe, fp): the table entry of every fingerprint in each segment (probe 0) and its probes in the Hamming ball around (probe 1).

    Of two fingerprints within `distance`, some segment differs in at most distance // segments bits, so one's entry meets the other's probe there.
    """
    layout = [(low, width, _balls(width, distance // segments)) for low, width in segment_bounds(segments)]
    schema = pa.schema([("bucket", pa.int64()), ("probe", pa.int8()), ("fp", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for number, (low, width, masks) in enumerate(layout):
                for at in range(0, len(fp), 4096):
                    some = fp[at:at + 4096]
                    part = some >> np.uint64(low) & np.uint64((1 << width) - 1)
                    bucket = (part[:, None] ^ masks[None, :]).ravel() * np.uint64(segments) + np.uint64(number)
                    probe = np.tile((masks != 0).astype(np.int8), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(probe), pa.array(np.repeat(some, len(masks)).view(np.int64))], schema=schema)

    return fps.select("fp").mapInArrow(spread, "bucket long, probe byte, fp long")


def _spanning(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each node by the given links."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_large(entry: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search in one bucket from its entries; every member leaves the unvisited ones once, so no pair list is built."""
    out, entries, probes = [], entry, probe
    while len(entries):
        queue, entries = [entries[0]], entries[1:]
        while queue:
            at = queue.pop()
            near = np.bitwise_count(entries ^ at) <= distance
            if near.any():
                found, entries = entries[near], entries[~near]
                out.append((np.full(len(found), at), found))
                queue += found.tolist()
            near = np.bitwise_count(probes ^ at) <= distance
            if near.any():
                found = probes[near]
                out.append((np.full(len(found), at), found))
                # A probe that is linked once still has to meet the entries that no entry reaches; it joins the search as one.
                probes = probes[~near]
                queue += found.tolist()
    return out


def link_buckets(bucket: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, sorted by bucket with entries before probes: at most one per member, with the same components as all pairs within `distance`."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([first, [len(bucket)]]))
    own = np.add.reduceat((probe == 0).astype(np.int64), first)
    use = (own > 0) & (size > 1)
    pairs = own * size
    large = use & (pairs > 1 << 14)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(large):
        members = fp[first[i]:first[i] + size[i]]
        links += _link_large(members[:own[i]], members[own[i]:], distance)
    small = np.flatnonzero(use & ~large)
    blocks = np.searchsorted(np.cumsum(pairs[small]), np.arange(_PAIRS_AT_ONCE, int(pairs[small].sum()) + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE), side="left") + 1
    start = 0
    for stop in np.unique(np.minimum(blocks, len(small))):
        part, start = small[start:stop], stop
        if not len(part):
            continue
        n = pairs[part]
        which = np.repeat(np.arange(len(part)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = first[part][which] + k // size[part][which]
        b = first[part][which] + k % size[part][which]
        near = (a < b) & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)
        a, b = a[near], b[near]
        if len(a):
            nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _spanning(len(nodes), inverse[:len(a)], inverse[len(a):])
            moved = root != np.arange(len(nodes))
            links.append((fp[nodes[root[moved]]], fp[nodes[moved]]))
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([x for x, _ in links]).astype(np.uint64), np.concatenate([y for _, y in links]).astype(np.uint64)


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition at bucket borders; holds one bucket and one batch at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[list[np.ndarray]] = []

    def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        bucket, probe, fp = (np.concatenate(c) for c in zip(*parts))
        a, b = link_buckets(bucket, probe, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    rows = 0
    for batch in batches:
        bucket, probe, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if rows + cut >= 1 << 17 and (cut or (held and held[-1][0][-1] != bucket[0])):
            yield flush(held + [[bucket[:cut], probe[:cut], fp[:cut]]])
            held, rows = [], 0
            bucket, probe, fp = bucket[cut:], probe[cut:], fp[cut:]
        held.append([bucket, probe, fp])
        rows += len(bucket)
    if held:
        yield flush(held)


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, no repeats) whose components equal those of all pairs within `distance`."""
    spark = fps.sparkSession
    rows = bucket_rows(fps, distance, segments)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "probe")
    return dealt.mapInArrow(lambda batches: _linked(batches, distance), "a long, b long")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of `distance` or fewer differing bits).

    Null and empty texts have fingerprint 0, linked like any other; null ids never name a component unless it has no other. Very long texts are hashed in blocks of shingles.
    Equal fingerprints collapse to one row before the search, so copies cost nothing. A bucket of very many different near fingerprints is searched breadth first and
    gives one link per member, never all pairs; a task holds 8 bytes for each different fingerprint of one bucket. Repeated rows are all returned; an
    empty table gives an empty result; other columns are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_column, text_column, words))
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(link_fingerprints(fps, distance, segments))
    rooted = fps.join(nodes, fps.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose doc_id names their component, with all their columns, whatever their names.

    An id is one document: rows that repeat the id of a kept one stay with it. Rows without an id stay only if some component has no other.
    """
    kept_id = fresh(docs, "_kept_id")
    kept = near_dedup(docs, id_column, text_column).select(F.col("component_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col(f"`{id_column}`").eqNullSafe(F.col(kept_id)), "left_semi")
