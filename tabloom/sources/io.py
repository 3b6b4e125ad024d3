"""Sources and sinks.

Reads and writes are Spark's own data sources (CSV, Parquet, JSON); nothing
passes through the driver. ``read_table`` infers the format from the path
suffix unless given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabloom.operators.schema import q


# A01 / A02 -------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None,
               **options) -> DataFrame:
    """CSV (header, inferred types unless a schema is given), Parquet or JSON."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


# A03 / A04 -------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), **options) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


# A07 -----------------------------------------------------------------------
def mapping_table(spark: SparkSession, cfg: Mapping) -> DataFrame:
    """(group, kind, input_key, label, flag_column) from a feature-mapping config
    with ``one_hot_features``/``binary_features`` (label -> flag) and
    ``special_cases`` (``output_keys``)."""
    rows = []
    for kind in ("one_hot_features", "binary_features"):
        for group, g in (cfg.get(kind) or {}).items():
            for label, flag in (g.get("mapping") or {}).items():
                rows.append((group, kind, g.get("input_key"), str(label), flag))
    for group, g in (cfg.get("special_cases") or {}).items():
        for label, flag in (g.get("output_keys") or {}).items():
            rows.append((group, "special_cases", g.get("input_key"), str(label), flag))
    return spark.createDataFrame(rows, "group string, kind string, input_key string, label string, flag_column string")


# A08 -----------------------------------------------------------------------
def feature_lists(spark: SparkSession, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """(model, feature_index, feature) per model plus the ordered master list
    (model = '__all__', first appearance order)."""
    per = spark.createDataFrame([(m, list(fs)) for m, fs in models.items()], "model string, features array<string>")
    long = per.select("model", F.posexplode("features").alias("feature_index", "feature"))
    first = long.groupBy("feature").agg(F.min(F.struct("model", "feature_index")).alias("_first"))
    master = first.select(F.lit("__all__").alias("model"), "feature", "_first")
    w = Window.partitionBy("model").orderBy("_first")
    master = master.select("model", (F.row_number().over(w) - 1).alias("feature_index"), "feature")
    return long.select("model", F.col("feature_index").cast("int"), "feature").unionByName(
        master.select("model", F.col("feature_index").cast("int"), "feature"))


# A09 -----------------------------------------------------------------------
def category_listing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_unique, value): every distinct value of each text column, a row each."""
    from tabloom.operators.profile import distinct_counts, text_cols
    cols = list(cols or text_cols(df))
    pairs = (df.select(*[q(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
             .where(F.col("value").isNotNull()).distinct())
    return distinct_counts(df, cols).join(pairs, "column", "left").select("column", F.col("n_distinct").alias("n_unique"), "value")
