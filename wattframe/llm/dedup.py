"""Exact deduplication through an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.text import fresh, lower_az
from wattframe.session import cut_lineage

BUCKET_ENTRIES = 100_000
MAX_DEPTH = 12


@dataclass(frozen=True)
class Directory:
    """`slots[i]` is the bucket of the hashes whose first `depth` bits are i."""

    depth: int
    slots: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return self.slots[-1] + 1

    def bucket(self, h: Column) -> Column:
        if self.depth == 0:
            return F.lit(0)
        listed = F.from_json(F.lit(str(list(self.slots))), "array<int>")
        return F.element_at(listed, (F.shiftrightunsigned(h, 64 - self.depth) + 1).cast("int"))


def grow_directory(cells: dict[int, int], bucket_entries: int, max_depth: int) -> Directory:
    """Inserts all entries at once, given their number in each of the 2**max_depth cells of leading bits.

    Starts with one bucket; an overfull one splits in two, and the directory doubles when the bucket is as deep as the directory itself. A bucket at
    max_depth chains its surplus.
    """
    sums = [0]
    for cell in range(1 << max_depth):
        sums.append(sums[-1] + cells.get(cell, 0))
    leaves, todo, depth = [], [(0, 0)], 0
    while todo:
        prefix, local = todo.pop()
        width = 1 << (max_depth - local)
        if sums[(prefix + 1) * width] - sums[prefix * width] > bucket_entries and local < max_depth:
            depth = max(depth, local + 1)
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            leaves.append((prefix, local))
    slots = [bucket for bucket, (_, local) in enumerate(leaves) for _ in range(1 << (depth - local))]
    return Directory(depth, tuple(slots))


def keyed(docs: DataFrame, id_column: str, text_column: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, normal (the normalised text) and its 64-bit h."""
    normal = docs.select(F.col(f"`{id_column}`").alias("doc_id"), lower_az(F.col(f"`{text_column}`")).alias("normal"))
    return normal.select("doc_id", "normal", hashed(F.col("normal")).alias("h"))


@dataclass(frozen=True)
class Index:
    """Directory and entries; `entries` holds bucket, h, link (place in the chain of entries that share h), sha, keep_id, group_size."""

    directory: Directory
    entries: DataFrame

    def find(self, h: Column, sha: Column, probes: DataFrame) -> DataFrame:
        """`probes` with link, keep_id and group_size: the directory names the bucket, h the chain in it, the digest the link of the chain."""
        routed = probes.withColumns({"bucket": self.directory.bucket(h), "h": h, "sha": sha})
        return routed.join(self.entries, ["bucket", "h", "sha"])


def build_index(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH,
    hashed: Callable[[Column], Column] = F.xxhash64,
) -> Index:
    """The index: one entry per different text, as a table in the shared folder.

    The directory grows first, from the number of hashes in each cell of leading bits, and has at most 2**max_depth slots whatever the input. It routes every row
    to a bucket; the owner of a key (bucket, h) compares the bytes of all its texts: the smallest and the largest are equal, and so are all, or the key is a
    collision. Copies collapse before they are sent, so a text that makes up a third of all rows is sent once per map task. Collisions (about n * n / 2**65 for n texts) go
    back to their owners, who chain the different texts of a key by digest. Each writer holds one range of (bucket, h). Entries whose 256-bit digests collide would
    make a look-up ambiguous and fail the job.
    """
    rows = keyed(docs, id_column, text_column, hashed)
    cell = F.shiftrightunsigned("h", 64 - max_depth).alias("cell")
    counted = {r["cell"]: r["count"] for r in rows.select("h").distinct().groupBy(cell).count().collect()}
    directory = grow_directory(counted, bucket_entries, max_depth)
    routed = rows.withColumn("bucket", directory.bucket(F.col("h")))
    size = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    owned = routed.groupBy("bucket", "h").agg(F.min("normal").alias("_low"), F.max("normal").alias("_high"), *size)
    digest = F.unhex(F.sha2("_low", 256))
    owned = cut_lineage(owned.select("bucket", "h", (F.col("_low") == F.col("_high")).alias("_alone"), F.when(F.col("_low") == F.col("_high"), digest).alias("sha"), "keep_id", "group_size"))
    columns = ["bucket", "h", "link", "sha", "keep_id", "group_size"]
    entries = owned.where("_alone").withColumn("link", F.lit(1)).select(*columns)
    collisions = owned.where("NOT _alone").select("bucket", "h")
    if not collisions.isEmpty():
        texts = routed.join(collisions, ["bucket", "h"], "left_semi").groupBy("bucket", "h", "normal").agg(*size)
        chain = Window.partitionBy("bucket", "h").orderBy("sha")
        chained = texts.withColumn("sha", F.unhex(F.sha2("normal", 256))).withColumn("link", F.row_number().over(chain)).withColumn("_before", F.lag("sha").over(chain))
        clash = F.raise_error(F.lit("two texts share a 256-bit digest")).cast("binary")
        checked = chained.withColumn("sha", F.when(F.col("_before") == F.col("sha"), clash).otherwise(F.col("sha")))
        entries = entries.unionByName(checked.select(*columns))
    return Index(directory, cut_lineage(entries.repartitionByRange(directory.buckets, "bucket", "h").sortWithinPartitions("bucket", "h", "link")))


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH,
    hashed: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row with the largest doc_id of a group stays. A null doc_id is
    smaller than any other and stays only in a group without other ids; rows that repeat the id which stays are one document and all marked kept. An empty table
    gives an empty result. Other columns are not read. `hashed` gives the 64-bit key of a text; a poor one costs time and changes no row.
    """
    index = build_index(docs, id_column, text_column, bucket_entries, max_depth, hashed)
    rows = keyed(docs, id_column, text_column, hashed).select("doc_id", "h", F.unhex(F.sha2("normal", 256)).alias("sha"))
    found = index.find(F.col("h"), F.col("sha"), rows)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that `exact_dedup` marks as kept, with all their columns, whatever their names: those whose id and text are both those of an index entry.

    Null texts count as empty; null ids, repeated ids and an empty table are treated as `exact_dedup` does.
    """
    keep_id, digest = fresh(docs, "_keep_id"), fresh(docs, "_digest")
    kept = build_index(docs, id_column, text_column).entries.select(F.col("keep_id").alias(keep_id), F.col("sha").alias(digest))
    own = F.unhex(F.sha2(lower_az(F.col(f"`{text_column}`")), 256))
    return docs.join(kept, F.col(f"`{id_column}`").eqNullSafe(F.col(keep_id)) & (own == F.col(digest)), "left_semi")


ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY normal) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size, normal FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""
