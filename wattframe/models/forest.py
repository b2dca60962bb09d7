"""Isolation forest over many models at once.

A model is a series, or a 48-hour block of one. Each tree draws a bounded hash
sample of all rows its model may learn from, so a fit is one small task; rows
are scored in chunks, so no task ever holds a whole group. The rows that may be
drawn travel to the chunks, once each, and the forest is grown there. Sampling
and seeds depend only on keys, never on the partitioning.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe import constants as C
from wattframe.operators.quantiles import exact_percentiles
from wattframe.operators.series import attach
from wattframe.session import cut_lineage

# The task functions below travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 500_000
SCORE_ROWS = 16_384
TASKS_A_SLOT = 4
PLACES = 2**40
_FOREST = "feature array<int>, threshold array<double>, child array<int>, depth array<double>, trees int, psi int"


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    inner = np.maximum(n - 1.0, 1.0)
    return np.where(n > 2, 2.0 * (np.log(inner) + np.euler_gamma) - 2.0 * inner / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def ends(ranks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest rank (input, node) of the columns of each node, which lie side by side."""
    if counts.mean() > 16:
        return np.minimum.reduceat(ranks, starts, axis=1), np.maximum.reduceat(ranks, starts, axis=1)
    # Many short nodes: the longest first, so that those with a further column are the first ones.
    order = np.argsort(-counts, kind="stable")
    starts, longer = starts[order], len(counts) - np.bincount(counts).cumsum()
    low = np.take(ranks, starts, axis=1)
    high = low.copy()
    for j in range(1, len(longer) - 1):
        n = longer[j]
        column = np.take(ranks, starts[:n] + j, axis=1)
        np.minimum(low[:, :n], column, out=low[:, :n])
        np.maximum(high[:, :n], column, out=high[:, :n])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return low[:, back], high[:, back]


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values (input, rank) in order, and the rank (input, row) of every value, in the narrowest type."""
    found = [np.unique(column, return_inverse=True) for column in x.T]
    size = max(len(values) for values, _ in found)
    table = np.zeros((len(found), size))
    for row, (values, _) in zip(table, found):
        row[:len(values)] = values
    return table, np.array([place for _, place in found]).astype(np.min_scalar_type(size - 1))


def grow(x: np.ndarray, drawn: np.ndarray, tree: np.ndarray, trees: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """All trees level by level from the rows of `x` that each drew (`tree` per draw). Node t is the root of tree t; the right child follows the left."""
    table, ranks = ranked(x)
    rows, node = drawn, tree
    psi = len(drawn) // trees
    limit = int(np.ceil(np.log2(max(psi, 2))))
    feature, threshold, child, depth = [], [], [], []
    first, level = 0, trees
    for d in range(limit + 1):
        # The numbers of a level's nodes are sorted in their narrowest type, which is far faster.
        order = np.argsort((node - first).astype(np.min_scalar_type(level)), kind="stable")
        rows, node = rows[order], node[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        counts = np.diff(np.r_[starts, len(node)])
        low, high = ends(np.take(ranks, rows, axis=1), starts, counts)
        usable = (high > low).T
        split = usable.any(axis=1) & (d < limit)
        pick = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        at = np.arange(len(starts))
        low, high = table[pick, low[pick, at]], table[pick, high[pick, at]]
        cut = low + rng.random(len(starts)) * (high - low)
        next_first = first + level
        cut = np.where(cut < high, cut, low)  # rounding must not empty the right side
        kids = np.where(split, next_first + 2 * (np.cumsum(split) - 1), -1)
        feature.append(np.where(split, pick, 0))
        threshold.append(np.where(split, cut, 0.0))
        child.append(kids)
        depth.append(np.where(split, 0.0, d + _average_path(counts)))
        if not split.any():
            break
        group = np.repeat(at, counts)
        goes = split[group]
        rows, group = rows[goes], group[goes]
        right = x[rows, pick[group]] > cut[group]
        node = kids[group] + right
        first, level = next_first, 2 * int(split.sum())
    return {
        "feature": np.concatenate(feature).astype(np.int32), "threshold": np.concatenate(threshold),
        "child": np.concatenate(child).astype(np.int32), "depth": np.concatenate(depth), "trees": trees, "psi": psi,
    }


def score(x: np.ndarray, forest: dict) -> np.ndarray:
    """-2^(-E[h]/c): near -1 is unusual. Slices bound the rows-by-trees work array."""
    slices = [_score(x[i:i + SCORE_ROWS], forest) for i in range(0, len(x), SCORE_ROWS)]
    return np.concatenate(slices) if slices else np.empty(0)


def _score(x: np.ndarray, forest: dict) -> np.ndarray:
    feature, threshold, child = (np.asarray(forest[k]) for k in ("feature", "threshold", "child"))
    depth = np.asarray(forest["depth"])
    node = np.broadcast_to(np.arange(int(forest["trees"])), (len(x), int(forest["trees"]))).copy()
    at = np.arange(len(x))[:, None]
    for _ in range(64):
        kids = child[node]
        inner = kids >= 0
        if not inner.any():
            break
        right = x[at, feature[node]] > threshold[node]
        node = np.where(inner, kids + right, node)
    scale = float(_average_path(np.array(forest["psi"])))
    return -np.power(2.0, -depth[node].mean(axis=1) / max(scale, 1e-12))


def _rng(model: object, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(model).encode())])


def isolation_scores(
    rows: DataFrame, names: Sequence[str], model: str, row_key: Sequence[str], fit: str = "fit",
    trees: int = C.FOREST_TREES, sample: int = C.FOREST_SAMPLE, contamination: float = C.FOREST_CONTAMINATION, seed: int = C.FOREST_SEED,
    chunk_rows: int = CHUNK_ROWS, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `anomaly_score` (below zero is unusual; not a probability) to complete, numeric rows, of which the columns `keep` (default: all) are returned.

    `fit` marks the rows a model may learn from; with fewer than two of them
    the score is null. The cut is the contamination percentile of the fit scores.
    """
    names, row_key = list(names), list(row_key)
    keep = list(rows.columns if keep is None else keep)
    sized = _sized(rows, model, fit)
    # Forests are grown where the rows are scored: the forest of a short series is far larger than its rows.
    pool = _pool(sized, names, model, row_key, fit, trees, sample, seed)
    pool = pool.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_rows") / chunk_rows) - 1)))
    forest = lambda drawn: _forest(drawn, names, model, row_key, trees, sample, seed)
    needed = list(dict.fromkeys([*keep, model, fit]))
    raw = cut_lineage(_scored(sized, pool, forest, needed, names, model, row_key, chunk_rows, seed))
    joined = attach(raw, _cuts(raw, model, fit, contamination), [model])
    return joined.select(*keep, (F.col("anomaly_score") - F.col("_cut")).alias("anomaly_score"))


def _sized(rows: DataFrame, model: str, fit: str | None) -> DataFrame:
    """Rows with the size of their model, and with the number of rows it may learn from."""
    learnt = [F.count_if(F.col(fit)).alias("_fit_rows")] if fit else []
    return attach(rows, rows.groupBy(model).agg(F.count(F.lit(1)).alias("_rows"), *learnt), [model], "inner")


def _cuts(raw: DataFrame, model: str, fit: str, contamination: float) -> DataFrame:
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be above 0 and at most 0.5")
    return exact_percentiles(raw.where(F.col(fit)), F.col("anomaly_score"), {"_cut": contamination}, [model])


def _pool(sized: DataFrame, names: list[str], model: str, row_key: list[str], fit: str, trees: int, sample: int, seed: int) -> DataFrame:
    """The rows that some tree may draw, once each: all fit rows of a short series, of a long one about 2 * `sample` for every tree. `_hash` places a row for each tree."""
    of_row = F.xxhash64(model, *row_key, F.lit(seed))
    place = lambda tree: F.pmod(F.xxhash64(model, *row_key, F.lit(seed), tree), F.lit(PLACES)) / F.lit(float(PLACES))
    share = F.lit(2.0 * sample) / F.col("_fit_rows")
    drawn = (F.col("_fit_rows") <= 2 * sample) | F.exists(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) <= share)
    pool = sized.where(F.col(fit) & (F.col("_fit_rows") >= 2) & drawn)
    # Under names of its own, the pool can meet the rows it comes from.
    return pool.select("_rows", "_fit_rows", of_row.alias("_hash"), *[F.col(c).alias(c) for c in dict.fromkeys([model, *row_key, *names])])


def places(row: np.ndarray, tree: int) -> np.ndarray:
    """Where in [0, 1) the rows with these hashes lie for a tree: XXH64 of the tree's number with the row's hash as seed, as xxhash64 chains its columns."""
    one, two, three, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (row.astype(np.int64).view(np.uint64) + five + np.uint64(4)) ^ (np.array([tree], np.uint64) * one)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return ((h ^ h >> np.uint64(32)) % np.uint64(PLACES)).astype(float) / float(PLACES)


def draw(row: np.ndarray, fit_rows: int, trees: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, trees): every tree draws the `sample` rows with the smallest places, or all if there are no more. Equal places stay in order."""
    if fit_rows <= sample:
        return np.tile(np.arange(len(row)), trees), np.repeat(np.arange(trees), len(row))
    drawn = []
    for tree in range(trees):
        place = places(row, tree)
        near = np.flatnonzero(place <= 2.0 * sample / fit_rows)
        drawn.append(near[np.argsort(place[near], kind="stable")][:sample])
    return np.concatenate(drawn), np.repeat(np.arange(trees), [len(d) for d in drawn])


def _matrix(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([rows[n].to_numpy().astype(float, copy=False) for n in names])


def _forest(pool: pa.Table, names: list[str], model: str, row_key: list[str], trees: int, sample: int, seed: int) -> dict:
    """The forest of one model from its rows of `_pool`."""
    pool = pool.take(pc.sort_indices(pool, [(c, "ascending") for c in row_key], null_placement="at_start"))
    rows, tree = draw(pool["_hash"].to_numpy(), pool["_fit_rows"][0].as_py(), trees, sample)
    return grow(_matrix(pool, names), rows, tree, trees, _rng(pool[model][0].as_py(), seed))


def _grown(sized: DataFrame, names: list[str], model: str, row_key: list[str], fit: str, trees: int, sample: int, seed: int) -> DataFrame:
    """One forest per model with at least two rows to learn from."""
    key_type = dict(sized.dtypes)[model]

    def fit_model(rows: pa.Table) -> pa.Table:
        forest = _forest(rows, names, model, row_key, trees, sample, seed)
        lists = {k: pa.array([v]) if isinstance(v, np.ndarray) else pa.array([v], pa.int32()) for k, v in forest.items()}
        return pa.table({model: rows[model].slice(0, 1), **lists})

    pool = _pool(sized, names, model, row_key, fit, trees, sample, seed)
    return pool.groupBy(model).applyInArrow(fit_model, f"`{model}` {key_type}, {_FOREST}")


def _copied(forests: DataFrame, sized: DataFrame, model: str, chunk_rows: int) -> DataFrame:
    """A copy of each forest for every chunk of its model's rows."""
    chunks = F.ceil(F.col("_rows") / chunk_rows)
    copies = sized.select(model, "_rows").distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    return forests.join(copies.select(model, "_chunk"), model)


def _first_row(forests: pa.Table) -> dict:
    return forests.slice(0, 1).to_pylist()[0]


def _scored(
    sized: DataFrame, source: DataFrame, forest: Callable[[pa.Table], dict], columns: list[str], names: list[str], model: str, row_key: list[str], chunk_rows: int, seed: int
) -> DataFrame:
    """`columns` with the score before the cut; null where a model has no forest. `forest` makes one from the rows that `source` has for the model and chunk."""
    spread = sized.withColumn("_chunk", F.pmod(F.xxhash64(*row_key, F.lit(seed)), F.ceil(F.col("_rows") / chunk_rows)))
    spread = spread.select("_chunk", *dict.fromkeys([*columns, model, *names]))
    out_schema = ", ".join(f"`{c}` {t}" for c, t in sized.dtypes if c in columns) + ", anomaly_score double"
    columns = [c for c in sized.columns if c in columns]

    def score_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        none = right.num_rows == 0 or left.num_rows == 0
        scores = np.full(left.num_rows, np.nan) if none else score(_matrix(left, names), forest(right))
        return left.select(columns).append_column("anomaly_score", pa.array(scores))

    # Few bytes are much work here, so tasks are counted rather than merged by their size.
    spark = sized.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_SLOT * spark.sparkContext.defaultParallelism)
    dealt = lambda rows: rows.repartition(tasks, model, "_chunk").groupBy(model, "_chunk")
    raw = dealt(spread).cogroup(dealt(source)).applyInArrow(score_chunk, out_schema)
    return raw.withColumn("anomaly_score", F.nanvl("anomaly_score", F.lit(None)))


@dataclass
class Forests:
    """Fitted forests and cuts of many models, to score later rows of the same models."""

    forests: DataFrame
    cuts: DataFrame
    names: list[str]
    model: str
    seed: int = C.FOREST_SEED

    def predict(self, rows: DataFrame, row_key: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """Add `anomaly_score`, as isolation_scores does; null for a model without a forest."""
        sized = _sized(rows, self.model, None)
        raw = _scored(sized, _copied(self.forests, sized, self.model, chunk_rows), _first_row, rows.columns, self.names, self.model, list(row_key), chunk_rows, self.seed)
        return attach(raw, self.cuts, [self.model]).select(*rows.columns, (F.col("anomaly_score") - F.col("_cut")).alias("anomaly_score"))


def forest_fit(
    rows: DataFrame, names: Sequence[str], model: str, row_key: Sequence[str], fit: str = "fit",
    trees: int = C.FOREST_TREES, sample: int = C.FOREST_SAMPLE, contamination: float = C.FOREST_CONTAMINATION, seed: int = C.FOREST_SEED,
) -> Forests:
    """The forests and cuts that isolation_scores would use, kept as two tables."""
    names, row_key = list(names), list(row_key)
    sized = _sized(rows, model, fit)
    forests = cut_lineage(_grown(sized, names, model, row_key, fit, trees, sample, seed))
    raw = _scored(sized, _copied(forests, sized, model, CHUNK_ROWS), _first_row, list(dict.fromkeys([model, fit])), names, model, row_key, CHUNK_ROWS, seed)
    return Forests(forests, cut_lineage(_cuts(cut_lineage(raw), model, fit, contamination)), names, model, seed)
