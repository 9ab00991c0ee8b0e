"""Sources and sinks: parquet, CSV, JSON history tables, templates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from .arrays import load_arrays, save_arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, gzip or not; a byte order mark before the first name is dropped. With a schema nothing is inferred."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; no rows are parsed."""
    return [c.lstrip("﻿") for c in spark.read.option("header", True).csv(path).columns]


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def save_history(sums: DataFrame, path: str, period: str) -> None:
    """Sums by (keys, period) as Parquet, a folder for each period. Periods that lie there already are replaced by those of `sums`,
    others stay: a new period is added, or an old one made anew, without the rest being read."""
    sums.repartition(period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def load_history(spark: SparkSession, path: str, keys: Sequence[str], period: str, names: Sequence[str] = ("n", "s"), before=None, last: int | None = None) -> DataFrame:
    """(keys, names): the sums over all saved periods, over those before `before`, or over the `last` of those. Folders of other periods
    aren't read."""
    h = spark.read.parquet(path)
    if before is not None:
        h = h.where(F.col(period) < before)
        h = h if last is None else h.where(F.col(period) >= before - last)
    return h.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def period_scan(df: DataFrame, stamp: str, first_year: int, last_year: int) -> DataFrame:
    """Rows of whole years as a range of the time column, which Parquet readers can push down (year(stamp) can't be)."""
    kind = "timestamp_ntz" if dict(df.dtypes)[stamp] == "timestamp_ntz" else "timestamp"
    at = lambda y: F.lit(f"{y}-01-01 00:00:00").cast(kind)
    return df.where((F.col(stamp) >= at(first_year)) & (F.col(stamp) < at(last_year + 1)))


def require(df: DataFrame, columns: Sequence[str], ordered: bool = False) -> DataFrame:
    """Raises if columns are missing or, with ordered, stand in another order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if ordered and [c for c in df.columns if c in set(columns)] != list(columns):
        raise ValueError("columns stand in another order")
    return df


def outside_domain(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values of a column that its dictionary lacks, with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(values))).groupBy(column).agg(F.count("*").alias("n"))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merge_template(template: DataFrame, predictions: DataFrame, key: str, value: str, placeholder: Column | float = 0.5) -> DataFrame:
    """Each row of the template once, with its prediction or the placeholder, and whether it had one. Of repeated predictions the least counts;
    a null prediction is none."""
    p = predictions.select(key, F.col(value).alias("_p")).groupBy(key).agg(F.min("_p").alias("_p"))
    fill = placeholder if isinstance(placeholder, Column) else F.lit(placeholder)
    kept = template.drop(value) if value in template.columns else template
    return kept.join(p, key, "left").withColumn("matched", F.col("_p").isNotNull()).withColumn(value, F.coalesce("_p", fill)).drop("_p")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of sides whose keys must each be unique; raises otherwise."""
    for name, side in (("left", left), ("right", right)):
        if unique_key(side, keys).limit(1).count():
            raise ValueError(f"keys of the {name} side repeat")
    return left.join(right, list(keys))


def contract_digest(df: DataFrame) -> str:
    """SHA-256 of the ordered column names and types."""
    return hashlib.sha256("\n".join(f"{c}:{t}" for c, t in df.dtypes).encode()).hexdigest()


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values in the order of the columns; null differs from empty, and values can't run into each other."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *[part(c) for c in columns]), 256)


def config_digest(config: dict) -> str:
    """SHA-256 of plain settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def lookup_csv(spark: SparkSession, path: str, key: str, value: str, schema: T.StructType | str | None = None) -> DataFrame:
    """(key, value) of a CSV that maps one to the other: rows without either are left out, repeated rows count once, and a key with two values raises."""
    out = read_csv(spark, path, schema, [key, value]).dropna().distinct()
    if (twice := [r[0] for r in unique_key(out, [key]).limit(3).collect()]):
        raise ValueError(f"keys with several values: {twice}")
    return out


def checked_template(template: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """The template's rows with their predictions, each exactly once: raises if a key repeats on either side, if a row has no prediction or a
    null or NaN one, or if a prediction has no row."""
    for name, side in (("template", template), ("predictions", predictions)):
        if unique_key(side, [key]).limit(1).count():
            raise ValueError(f"keys of the {name} repeat")
    p = predictions.select(key, F.col(value).cast("double").alias("_p"), F.lit(True).alias("_known"))
    t = template.drop(value).withColumn("_row", F.lit(True)) if value in template.columns else template.withColumn("_row", F.lit(True))
    both = t.join(p, key, "full")
    bad = both.agg(F.count_if(F.col("_known").isNull()).alias("missing"), F.count_if(F.col("_known") & (F.col("_p").isNull() | F.isnan("_p"))).alias("null"), F.count_if(F.col("_row").isNull()).alias("unknown")).first()
    if any(bad):
        raise ValueError(f"predictions: {bad.asDict()}")
    return both.withColumnRenamed("_p", value).drop("_known", "_row")


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the keys' rows, chosen by a hash of (key, seed): the same in every run and partitioning, and a smaller share's rows are
    among those of a larger one."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def position_split(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Adds is_first: whether the row is among the first `share` of the rows by a unique numeric key. The cut is an exact quantile found
    by brackets, so no window or task has all rows. Without rows or keys is_first is null."""
    cut = exact_quantiles(df, {key: [share]})[key][0]
    return df.withColumn("is_first", F.col(key) <= F.lit(cut).cast("double"))


def save_bundle(spark: SparkSession, path: str, arrays: dict, features: list[str], prior: float, **more) -> None:
    """A model's arrays with the order of its features, the prior and other plain values, as Parquet on any store."""
    save_arrays(spark, f"{path}/arrays", arrays)
    spark.createDataFrame([(json.dumps({"features": list(features), "prior": prior, **more}),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(arrays, meta) of save_bundle."""
    return load_arrays(spark, f"{path}/arrays"), json.loads(spark.read.parquet(f"{path}/meta").first()[0])


def cached_features(df: DataFrame, path: str, version: str) -> DataFrame:
    """df from `path` if a finished copy with these columns and this version lies there, else written there first."""
    spark, at = df.sparkSession, f"{path}/{hashlib.sha256((version + contract_digest(df)).encode()).hexdigest()[:16]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
