"""Fitted models by kind, key and version, published as a whole and found by time.

A key is an asset or the pool that an asset belongs to. Models are first staged
in a folder of their own; publishing adds one small file to the manifest, which
is the only thing a reader looks at. A writer that dies before that leaves
nothing a reader could find, and writers never share a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.models.boosted import DemandModels, Regression, SpikeModel, fit_together
from wattframe.models.cause import CauseModel
from wattframe.models.forest import Forests
from wattframe.operators.series import attach
from wattframe.session import cut_lineage

KINDS = ("demand", "generation", "spike", "deviation", "forest")
MANIFEST = (
    "kind string, key string, version string, valid_from timestamp, published_at timestamp, form string, path string, details string, batch string"
)
_RANK = ("valid_from", "published_at", "version", "path")


# --- what a model consists of: boosters, tables, and a few values -----------------


@dataclass
class Parts:
    boosters: dict[str, object]
    tables: dict[str, DataFrame]
    details: dict


def _take_apart(model: object) -> Parts:
    if isinstance(model, DemandModels):
        rmse = {str(h): e for h, e in model.rmse.items()}
        return Parts({f"h{h}": m for h, m in model.models.items()}, {"medians": model.medians}, {"names": model.names, "horizons": list(model.models), "rmse": rmse})
    if isinstance(model, Regression):
        return Parts({"model": model.model}, {"medians": model.medians}, {"names": model.names})
    if isinstance(model, SpikeModel):
        return Parts({f"c{i}": m for i, m in enumerate(model.models)}, {"medians": model.medians}, {"names": model.names, "classes": len(model.models)})
    if isinstance(model, CauseModel):
        inner = _take_apart(model.regression)
        return Parts(inner.boosters, inner.tables, inner.details | {"categories": model.categories})
    if isinstance(model, Forests):
        return Parts({}, {"forests": model.forests, "cuts": model.cuts}, {"names": model.names, "model": model.model, "seed": model.seed})
    raise TypeError(f"no way to keep a {type(model).__name__}")


def load(spark: SparkSession, form: str, path: str, details: str) -> object:
    """The model of a manifest row."""
    known = json.loads(details)
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    if form == "DemandModels":
        models = {h: GBTRegressionModel.load(f"{path}/h{h}") for h in known["horizons"]}
        return DemandModels(models, table("medians"), known["names"], {int(h): e for h, e in known["rmse"].items()})
    if form in ("Regression", "CauseModel"):
        regression = Regression(GBTRegressionModel.load(f"{path}/model"), table("medians"), known["names"])
        return CauseModel(regression, known["categories"]) if form == "CauseModel" else regression
    if form == "SpikeModel":
        return SpikeModel([GBTClassificationModel.load(f"{path}/c{i}") for i in range(known["classes"])], table("medians"), known["names"])
    if form == "Forests":
        return Forests(table("forests"), table("cuts"), known["names"], known["model"], known["seed"])
    raise ValueError(f"unknown form of model {form!r}")


# --- writing ----------------------------------------------------------------------


@dataclass(frozen=True)
class Staged:
    """Models that are written but not yet to be found."""

    root: str
    batch: str
    rows: tuple[tuple, ...]


def stage(root: str, models: Mapping[tuple[str, str], object], version: str, valid_from: datetime) -> Staged:
    """Write models by (kind, key). `valid_from` is the end of what they learnt: they may serve from then on."""
    unknown = sorted({kind for kind, _ in models} - set(KINDS))
    if unknown or not models:
        raise ValueError(f"unknown kinds {unknown}; choose of {KINDS}" if unknown else "no models to stage")
    batch, rows = uuid.uuid4().hex, []
    for i, ((kind, key), model) in enumerate(sorted(models.items(), key=lambda m: m[0])):
        path, parts = f"{root}/staged/{batch}/{i}", _take_apart(model)
        for name, booster in parts.boosters.items():
            booster.write().save(f"{path}/{name}")
        for name, table in parts.tables.items():
            table.write.parquet(f"{path}/{name}")
        rows.append((kind, key, version, valid_from, type(model).__name__, path, json.dumps(parts.details)))
    return Staged(root, batch, tuple(rows))


def publish(spark: SparkSession, staged: Staged, published_at: datetime | None = None) -> str:
    """Make all models of a stage visible at once: the commit of one file. Returns the batch."""
    at = published_at or datetime.now(timezone.utc)
    rows = [(kind, key, version, valid, at, form, path, details, staged.batch) for kind, key, version, valid, form, path, details in staged.rows]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{staged.root}/manifest/{staged.batch}")
    return staged.batch


# --- reading ----------------------------------------------------------------------


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published models. A version published anew for its kind and key replaces the older one. Nothing published yet: no rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    keys = ["kind", "key", "version"]
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("published_at", "batch")).alias("_row"))
    return newest.select(*keys, "_row.*").select(*rows.columns)


def find(spark: SparkSession, root: str, kind: str, keys: Sequence[str], version: str | None = None, at: datetime | None = None) -> object:
    """The model of the first of `keys` (asset, then pool) that has one: of that version, or the newest that may serve `at` that time."""
    rows = manifest(spark, root).where((F.col("kind") == kind) & F.col("key").isin(list(keys)))
    if version is not None:
        rows = rows.where(F.col("version") == version)
    if at is not None:
        rows = rows.where(F.col("valid_from") <= F.lit(at))
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    best = rows.orderBy(place, *[F.col(c).desc() for c in _RANK]).first()
    if best is None:
        raise LookupError(f"no {kind} model of {list(keys)}" + (f", version {version}" if version else "") + (f", at {at}" if at else ""))
    return load(spark, best["form"], best["path"], best["details"])


def choose(rows: DataFrame, published: DataFrame, kind: str, asset: str = "asset_id", pool: str = "energy_type", at: str = "timestamp") -> DataFrame:
    """Add `model_key`, `model_version` and `model_path` of the newest model that could serve at the time of each row.

    A model of the asset goes before one of its pool, however new that is. Rows without either keep nulls. The manifest is grouped to one list of
    versions per key and joined once for the asset and once for the pool, so rows are never multiplied.
    """
    listed = published.where(F.col("kind") == kind).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*_RANK))).alias("_versions"))
    columns = rows.columns

    def newest(key: str, place: str) -> Column:
        served = F.filter("_versions", lambda v: v["valid_from"] <= F.col(at))
        best = F.try_element_at(served, F.lit(-1))
        return F.when(best.isNotNull(), F.struct(F.col(key).alias("key"), best["version"].alias("version"), best["path"].alias("path"))).alias(place)

    own = attach(rows, listed.withColumnRenamed("key", asset), [asset]).select(*columns, newest(asset, "_own"))
    both = attach(own, listed.withColumnRenamed("key", pool), [pool]).select(*columns, F.coalesce("_own", newest(pool, "_pool")).alias("_model"))
    return both.select(*columns, *[F.col(f"_model.{c}").alias(f"model_{c}") for c in ("key", "version", "path")])


def predict_at_time(
    rows: DataFrame, published: DataFrame, kind: str, output: str, score: Callable[[object, DataFrame], DataFrame] | None = None, **columns: str,
) -> DataFrame:
    """The rows of `choose`, each with the `output` of its model, null where there is none.

    One pass per model in use over its own rows, so the driver sees the models, never the rows. `score` takes a model and rows and adds `output`; by default a
    regression does so, which also gives the rows back with their inputs filled.
    """
    score = score or (lambda model, part: model.predict(part, output))
    chosen = cut_lineage(choose(rows, published, kind, **columns))
    used = chosen.where("model_path IS NOT NULL").select(F.col("model_path").alias("path")).distinct()
    kept = published.join(used, "path", "left_semi").select("form", "path", "details").collect()
    loaded = fit_together({m["path"]: (lambda m=m: load(rows.sparkSession, m["form"], m["path"], m["details"])) for m in kept}) if kept else {}
    out = chosen.where("model_path IS NULL").withColumn(output, F.lit(None).cast("double"))
    for path, model in loaded.items():
        out = out.unionByName(score(model, chosen.where(F.col("model_path") == path)))
    return out
