"""Near copies by the exact Jaccard similarity of their word shingles; SimHash fingerprints and MinHash bands find the pairs to check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.components import connected_components
from wattframe.llm.simhash import fingerprint, link_fingerprints
from wattframe.llm.text import fresh, mix, record_batches, texts_of, word_hashes, word_table
from wattframe.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 25  # a pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8**5)**25 = 5e-5
BAND_HASHES = 5
_SHINGLES_AT_ONCE = 1 << 12
_WORDS = word_table()
_DRAWS = np.random.Generator(np.random.PCG64(58))
_SALTS = _DRAWS.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _DRAWS.integers(0, 1 << 31, (BANDS * BAND_HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _DRAWS.integers(0, 1 << 32, (BANDS * BAND_HASHES, 1), dtype=np.uint32)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different 64-bit hashes of a text's runs of `words` words, A-Z lower-cased, in order. A shorter text is one run; no words: none."""
    h = word_hashes(text.lower(), _WORDS)
    if not len(h):
        return h
    n = min(words, len(h))
    runs = len(h) - n + 1
    total = np.full(runs, n, dtype=np.uint64)
    for i in range(n):
        total += mix(h[i:i + runs] + _SALTS[i]) * _SALTS[i]
    return np.unique(mix(total))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key a band: its minimal values under BAND_HASHES permutations of the 32-bit halves."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _SHINGLES_AT_ONCE):
        least = np.minimum(least, (high[None, at:at + _SHINGLES_AT_ONCE] * _FACTORS + _TERMS).min(axis=1))
    rows = least.reshape(BANDS, BAND_HASHES).astype(np.uint64) + np.uint64(1)
    return mix((rows * _SALTS[:BAND_HASHES]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def signatures(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key (of the text), digest and size of the set of shingles, its bands (none for an empty set), SimHash fingerprint of the shingles; one row per row of `docs` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("digest", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("fp", pa.int64())])

    def make(batch: pa.RecordBatch) -> list:
        texts = list(texts_of(batch.column(2)))
        sets = [shingles(t, words) for t in texts]
        keys = [bands(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
        fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return [batch.column(0), batch.column(1), [_digest(s) for s in sets], [len(s) for s in sets], keys, fps.view(np.int64)]

    picked = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return picked.mapInArrow(lambda batches: record_batches(batches, make, schema), "doc_id long, key long, digest long, size long, bands array<long>, fp long")


def _sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """digest, hashes of the texts with the given keys."""
    schema = pa.schema([("digest", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> list:
        sets = [shingles(t, words) for t in texts_of(batch.column(0))]
        return [[_digest(s) for s in sets], [s.view(np.int64) for s in sets]]

    def each(batches):
        # Sets are larger than texts; few at a time keep a batch small.
        return record_batches((b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)), make, schema)

    keyed = docs.select(F.xxhash64("text").alias("key"), "text").join(keys, "key", "left_semi")
    return keyed.groupBy("key").agg(F.min("text").alias("text")).select("text").mapInArrow(each, "digest long, hashes array<long>")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets have at least the given Jaccard similarity."""
    left = sets.select(F.col("digest").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")


def sketch_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are linked within the distance of simhash.py, one link per fingerprint, and the sets of one fingerprint with the first of them."""
    held = cut_lineage(marked.where("size > 0").select("fp", "digest").distinct())
    first = held.groupBy("fp").agg(F.min("digest").alias("first"))
    same = held.join(first, "fp").select(F.col("digest").alias("a"), F.col("first").alias("b"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("a", "b")]
    near = link_fingerprints(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every set of a bucket with the bucket's most typical one, that whose buckets hold most sets. `shared`: digest, bucket, n (sets of the bucket)."""
    score = shared.groupBy("digest").agg(F.sum("n").alias("score"))
    pivots = shared.join(score, "digest").groupBy("bucket").agg(F.max(F.struct("score", "digest"))["digest"].alias("pivot"))
    ends = [F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b")]
    return shared.join(pivots, "bucket").where("digest <> pivot").select(*ends).distinct()


def prefix_pairs(rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a superset of the pairs of `rooted` (digest, size, root) with different roots and the similarity, by an exact set join. `sets`: digest, hashes.

    Shingles are ordered by the number of sets that hold them, rarest first. Two sets of the similarity share one among the first of both: the shorter needs only as many as would leave
    too few common ones with a set of its own size, the longer as many as would leave too few with the shortest set allowed. What follows such a shingle bounds the common
    rest, which rejects most of what meets. So sets that share only what is frequent never meet, however many they are. In the list of a shingle the sets of its largest
    component are only met by those of others.
    """
    size, known = F.col("size"), sets.join(rooted, "digest")
    held = known.select("digest", F.explode("hashes").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    listed = held.join(common, "shingle").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("_l")).join(rooted, "digest")
    alone = size - F.size("_l")
    least = lambda share: F.ceil(share * size - 1e-9)
    reach = (size - least(F.lit(similarity)) + 1 - alone).cast("int")
    entries = listed.where(reach > 0).select("digest", "size", "root", alone.alias("_alone"), F.posexplode(F.slice("_l", 1, F.greatest(reach, F.lit(1)))).alias("_at", "_s"))
    entries = cut_lineage(entries.select("digest", "size", "root", (F.col("_alone") + F.col("_at")).alias("at"), F.col("_s.shingle").alias("shingle")))
    roots = entries.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1")
    met = entries.join(roots.select("shingle", "main"), "shingle")
    left = met.where("root <> main").select("shingle", F.col("digest").alias("a"), F.col("size").alias("m"), F.col("root").alias("r"), F.col("at").alias("p"))
    right = met.select("shingle", F.col("digest").alias("b"), F.col("size").alias("n"), F.col("root").alias("s"), F.col("at").alias("q"))
    joint = similarity / (1 + similarity)
    first = lambda at, size: F.col(at) < F.col(size) - F.ceil(F.lit(2 * joint) * F.col(size) - 1e-9) + 1
    shorter = F.when(F.col("m") <= F.col("n"), first("p", "m")).otherwise(False) | F.when(F.col("n") <= F.col("m"), first("q", "n")).otherwise(False)
    possible = F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q")) >= F.lit(joint) * (F.col("m") + F.col("n")) - 1e-6
    fits = (left.shingle == right.shingle) & (F.col("r") != F.col("s")) & (F.least("m", "n") >= F.greatest("m", "n") * F.lit(similarity) - 1e-6) & shorter & possible
    return left.join(right, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(marked: DataFrame, docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the digests in `marked` that are linked to another: the components of all pairs that share a band or a linked fingerprint and have the similarity.

    First every set is checked against those that SimHash links it to, and against the most typical one of each of its bands' buckets, which joins large groups by few pairs. The sets of
    buckets that still hold several components are then joined exactly, by their rarest shingles.
    """
    distinct = cut_lineage(marked.where("size > 0").groupBy("digest", "size", "bands").agg(F.min("key").alias("key")))
    rows = distinct.select("digest", "size", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(rows.join(crowded, "bucket"))
    sketched = cut_lineage(sketch_pairs(marked))
    paired = shared.select("digest").union(sketched.select("a")).union(sketched.select("b")).distinct()
    keys = distinct.join(paired, "digest", "left_semi").select("key")
    sets = cut_lineage(_sets(docs, keys, words))

    stars = cut_lineage(sketched.unionByName(star_pairs(shared)).distinct())
    links = cut_lineage(_checked(stars, sets, similarity))
    nodes = connected_components(links)
    rooted = cut_lineage(shared.join(nodes, shared.digest == nodes.node, "left").select("bucket", "digest", "size", F.coalesce("root", "digest").alias("root")))
    divided = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    apart = cut_lineage(rooted.join(divided, "bucket").select("digest", "size", "root").distinct())
    rest = prefix_pairs(apart, sets, similarity)
    more = _checked(cut_lineage(rest.join(stars, ["a", "b"], "left_anti")), sets, similarity)
    return connected_components(links.unionByName(more))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable over pairs whose sets of word shingles have at least `similarity`).

    Every link is an exact Jaccard similarity; a pair at 0.8 is met with a probability of 0.99995, a closer one with more. Texts without words are copies of each
    other. Null ids never name a component unless it has no other. Equal sets collapse before the search. Repeated rows are all returned; an empty table gives an empty result; other columns are not read.
    """
    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    marked = cut_lineage(signatures(picked, words))
    least = marked.groupBy("digest").agg(F.min("doc_id").alias("least"))
    nodes = similar_sets(marked, picked, words, similarity)
    rooted = cut_lineage(least.join(nodes, least.digest == nodes.node, "left").select("digest", "least", F.coalesce("root", "digest").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    return marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def drop_similar_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows whose doc_id names their component, with all their columns, whatever their names.

    An id is one document: rows that repeat the id of a kept one stay with it. Rows without an id stay only if some component has no other.
    """
    kept_id = fresh(docs, "_kept_id")
    kept = near_copies(docs, id_column, text_column, words, similarity).select(F.col("component_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col(f"`{id_column}`").eqNullSafe(F.col(kept_id)), "left_semi")
