"""Best-fit packing of documents into fixed windows under conflicts of source and duplicate cluster."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import lower_az
from wattframe.session import cut_lineage

WINDOW = 2048
SHARD_PIECES = 20_000
_BATCH = 1 << 16
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("bin", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()),
])
_DDL = "shard int, bin long, doc_id long, piece int, first_word long, words long, source string, cluster long"


class Bins:
    """Open bins of one shard, ordered by what they still hold.

    Every bin carries a bitmap of its sources and one of its clusters. A tree over the residuals 0..window holds in each node the intersection of the source bitmaps below, so
    the successor of a residual that has a bin without a given source is found in log(window) steps; a bin whose clusters conflict is passed over and the search
    goes on to the next. So the tightest compatible bin is found exactly.
    """

    ALL = -1  # no bin: every source seems taken

    def __init__(self, window: int):
        self.window, self.count = window, 0
        self.width = 1 << window.bit_length()
        self.tree = [self.ALL] * (2 * self.width)
        self.at: list[dict[int, tuple[int, int]]] = [{} for _ in range(window + 1)]

    def _refresh(self, residual: int) -> None:
        both = self.ALL
        for sources, _ in self.at[residual].values():
            both &= sources
        node = residual + self.width
        while node and self.tree[node] != both:
            self.tree[node] = both
            node >>= 1
            if node:
                both = self.tree[2 * node] & self.tree[2 * node + 1]

    def successor(self, least: int, source: int) -> int:
        """Smallest residual >= least with a bin that lacks the source, or -1."""
        tree, node = self.tree, least + self.width
        if node >= 2 * self.width:
            return -1
        if not tree[node] & source:
            return least
        while node > 1:
            if not node & 1 and not tree[node + 1] & source:
                node += 1
                while node < self.width:
                    node *= 2
                    if tree[node] & source:
                        node += 1
                return node - self.width
            node >>= 1
        return -1

    def place(self, size: int, source: int, cluster: int) -> int:
        """Puts an item into the tightest compatible bin (of equals the oldest), or a new one; returns the bin.

        Bit 0 belongs to no source; an item without one looks for a bin that lacks that bit, as every bin does.
        """
        lacking = source or 1
        residual = self.successor(size, lacking)
        while residual >= 0:
            fits = [b for b, (sources, clusters) in self.at[residual].items() if not sources & source and not clusters & cluster]
            if fits:
                chosen = min(fits)
                sources, clusters = self.at[residual].pop(chosen)
                self._refresh(residual)
                return self._put(chosen, residual - size, sources | source, clusters | cluster)
            residual = self.successor(residual + 1, lacking)
        self.count += 1
        return self._put(self.count - 1, self.window - size, source, cluster)

    def _put(self, number: int, residual: int, sources: int, clusters: int) -> int:
        if residual:  # a full bin can take nothing any more
            self.at[residual][number] = (sources, clusters)
            self._refresh(residual)
        return number


def pack(items: Iterable[tuple[int, object, object]], window: int) -> list[int]:
    """Bin of each item (size, source, cluster), placed in the given order. A null source or cluster conflicts with nothing."""
    items = list(items)
    repeated: dict[object, int] = {}
    for _, _, cluster in items:
        if cluster is not None:
            repeated[cluster] = repeated.get(cluster, 0) + 1
    places: dict[object, int] = {}
    clusters: dict[object, int] = {}
    bins = Bins(window)
    out = []
    for size, source, cluster in items:
        s = 0 if source is None else 2 << places.setdefault(source, len(places))
        c = 0 if repeated.get(cluster, 0) < 2 else 1 << clusters.setdefault(cluster, len(clusters))
        out.append(bins.place(size, s, c))
    return out


def count_words(text: Column) -> Column:
    """Words separated by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces_of(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, cluster, piece, first_word, words: texts longer than the window become several pieces of `window` words and a rest; an empty text is one piece of 0."""
    text = F.col(f"`{text_column}`").cast("string")
    measured = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"),
        F.when(text.isNotNull(), F.xxhash64(lower_az(text))).alias("cluster"), count_words(text).alias("total"),
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / window) - 1).cast("int")
    cut = measured.select("doc_id", "source", "cluster", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * window
    return cut.select("doc_id", "source", "cluster", "piece", first.alias("first_word"), F.least(F.lit(window).cast("long"), F.col("total") - first).alias("words"))


def best_fit(docs: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per piece: shard, bin, doc_id, piece, first_word, words, source, cluster.

    The pieces of a bin sum to `window` words at most, come from different sources and from different duplicate clusters (texts equal after lower-casing A-Z). Pieces are
    dealt by hash to shards of about `shard_pieces` and packed there, largest first, each into the tightest compatible bin of its shard; a shard that a hot
    key makes larger is packed in runs of `shard_pieces`, so memory stays bounded. Null sources and texts conflict with nothing; empty texts give one piece of 0
    words; repeated rows are packed apart; an empty table gives an empty result; other columns are not read. No piece is dropped.
    """
    pieces = cut_lineage(pieces_of(docs, window, id_column, text_column, source_column))
    shards = max(1, -(-pieces.count() // shard_pieces))
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source", "piece"), F.lit(shards)).cast("int"))
    dealt = keyed.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("words"), "doc_id", "piece", "source", "cluster")
    fields = ["shard", "doc_id", "piece", "first_word", "words", "source", "cluster"]

    def packed(shard: int, rows: list[tuple], first_bin: int) -> pa.RecordBatch:
        bins = pack([(r[4], r[5], r[6]) for r in rows], window)
        columns = list(zip(*rows))
        columns.insert(1, [first_bin + b for b in bins])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bins: dict[int, int] = {}
        for batch in batches:
            for row in zip(*(batch.column(f).to_pylist() for f in fields)):
                if held and (row[0] != held[0][0] or len(held) >= 2 * shard_pieces):
                    out = packed(held[0][0], held, bins.get(held[0][0], 0))
                    bins[held[0][0]] = bins.get(held[0][0], 0) + len(held)
                    yield out
                    held = []
                held.append(row)
        if held:
            yield packed(held[0][0], held, bins.get(held[0][0], 0))

    return dealt.select(*fields).mapInArrow(run, _DDL)
