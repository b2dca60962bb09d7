"""Merkle fixity audit of web archives: replicas are compared from the roots down, only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

FANOUT = 16
LEVELS = 3  # a segment has FANOUT ** LEVELS ids
NO_ID = -(1 << 63)


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC resource record; null url and html are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, id_column: str = "page_id", record_column: str = "record") -> DataFrame:
    """slot, size, digest: one leaf per id. Records that share an id are folded by sums of the lanes of their SHA-256 digests, whatever their order, so they
    need not gather."""
    hashed = records.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID)).alias("slot"), F.octet_length(f"`{record_column}`").cast("long").alias("size"), F.sha2(f"`{record_column}`", 256).alias("sha"),
    )
    lanes = [F.sum(F.conv(F.substring("sha", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"lane{i}") for i in range(4)]
    folded = hashed.groupBy("slot").agg(F.sum("size").alias("size"), F.count("*").alias("n"), *lanes)
    return folded.select("slot", "size", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"lane{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def _parent(slot: Column) -> Column:
    return F.shiftright(slot, FANOUT.bit_length() - 1)


def merkle_tree(records: DataFrame, id_column: str = "page_id", record_column: str = "record") -> list[DataFrame]:
    """Levels of a replica, leaves first: slot, digest, and from the leaves the offset range in their segment.

    A node is the digest of its children in the order of their slots, at most FANOUT of them. Every level is a table in the shared folder.
    """
    bottom = cut_lineage(leaves(records, id_column, record_column))
    segment = F.shiftright("slot", LEVELS * (FANOUT.bit_length() - 1))
    stop = F.sum("size").over(Window.partitionBy(segment).orderBy("slot"))
    tree = [cut_lineage(bottom.select("slot", (stop - F.col("size")).alias("start"), stop.alias("stop"), "digest"))]
    tree[0] = cut_lineage(tree[0])
    for _ in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct("slot", "start", "stop", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["slot"], c["digest"])), ",")
        level = tree[-1].groupBy(_parent(F.col("slot")).alias("slot")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(joined, 256).alias("digest"))
        tree.append(cut_lineage(level))
    return tree


def audit(primary: DataFrame, replica: DataFrame, id_column: str = "page_id", record_column: str = "record") -> DataFrame:
    """Ids whose records differ: page_id, segment, start, stop, expected, found, status (corrupt, missing or extra in the replica).

    Roots of segments are compared first, then the children of nodes that differ, level by level, so the comparison reads only mismatching branches. Offsets
    are those of the replica that has the record, the primary's first, with records in the order of their ids. Records without an id form one leaf; records that repeat an id are audited
    as one leaf and their order does not matter. Null records do not count as bytes but as records. An empty replica has all ids missing; two empty ones give an
    empty result. Other columns are not read.
    """
    trees = [merkle_tree(r, id_column, record_column) for r in (primary, replica)]
    differing = None
    for level in range(LEVELS, -1, -1):
        a, b = (t[level].select(F.col("slot").alias(f"slot_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("start", "stop", "digest")]) for t, s in zip(trees, "ab"))
        if differing is not None:
            a, b = (side.join(differing, _parent(F.col(f"slot_{s}")) == F.col("differing"), "left_semi") for side, s in ((a, "a"), (b, "b")))
        pairs = a.join(b, F.col("slot_a") == F.col("slot_b"), "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        pairs = cut_lineage(pairs)
        differing = pairs.select(F.coalesce("slot_a", "slot_b").alias("differing"))
    slot = F.coalesce("slot_a", "slot_b")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return pairs.select(
        F.when(slot != NO_ID, slot).alias("page_id"), F.shiftright(slot, LEVELS * (FANOUT.bit_length() - 1)).alias("segment"), F.coalesce("start_a", "start_b").alias("start"),
        F.coalesce("stop_a", "stop_b").alias("stop"), F.col("digest_a").alias("expected"), F.col("digest_b").alias("found"), status.alias("status"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def seven_bit_copy(pages: DataFrame, host_end: str = ".example.org") -> DataFrame:
    """The pages as a mirror has them that lost all non-ASCII characters of one domain in transfer."""
    lost = F.regexp_replace("html", r"[^\x00-\x7F]", "?")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
    return pages.withColumn("html", F.when(host.endswith(host_end), lost).otherwise(F.col("html")))


def _leaf_sql(name: str, html: str) -> str:
    lanes = ", ".join(f"sum(('0x' || substr(sha, {16 * i + 1}, 16))::UBIGINT::HUGEINT) AS lane{i}" for i in range(4))
    return f"""
{name}_r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
             || 'WARC-Record-ID: <page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({html}, '')) || chr(13) || chr(10)
             || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
{name}_h AS (SELECT page_id, strlen(record) AS size, sha256(record) AS sha FROM {name}_r),
{name} AS (SELECT page_id, sum(size)::BIGINT AS size, count(*) AS n, {lanes} FROM {name}_h GROUP BY page_id),
{name}_d AS (SELECT page_id, page_id >> 12 AS segment, (sum(size) OVER (PARTITION BY page_id >> 12 ORDER BY page_id))::BIGINT AS stop, size,
             sha256(concat_ws(':', n, lane0, lane1, lane2, lane3)) AS digest FROM {name})"""


_LOST = "CASE WHEN regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) LIKE '%.example.org' THEN regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g') ELSE html END"
ORACLE_SQL = f"""
WITH {_leaf_sql("a", "html")}, {_leaf_sql("b", _LOST)}
SELECT a_d.page_id, a_d.segment, a_d.stop - a_d.size AS start, a_d.stop, a_d.digest AS expected, b_d.digest AS found, 'corrupt' AS status
FROM a_d JOIN b_d USING (page_id) WHERE a_d.digest <> b_d.digest
"""
