"""Inputs built from the driver's test tables.

The test tables have no nulls and no multi-value cells, so every operator query
starts from a *project-like* wide row derived by Spark from the given tables,
with nulls, dirty text and semicolon cells made by rules that the SQL oracle
repeats exactly (``PROJECT_SQL``).

Scale notes
- ``nation``/``region`` are fixed-size TPC-H dimensions (25 / 5 rows) and are
  broadcast explicitly; ``customer`` and ``part`` grow with the data and are
  left to Spark's size-checked join selection (autoBroadcastJoinThreshold, AQE).
- The multi-value cell is built skew-safe: lines are first pre-aggregated to
  (order, value, n) with map-side combine, so an order holding a third of all
  lines shuffles one row per distinct value, not one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multivalue_cells(lines: DataFrame, key: str, values: list[str], sep: str = ";") -> DataFrame:
    """(key, one cell per value column): the values per ``key``, sorted, repeats kept.

    Lines are pre-aggregated to (key, values..., n) with map-side combine, so a
    hot key ships one row per distinct combination; each such row carries its
    repeats as a string (``array_repeat`` + ``concat_ws``), and per key the
    collected (value, repeats) structs are sorted and their strings joined.
    Built-ins only (no lambdas), so the whole step stays in code generation."""
    per = lines.groupBy(key, *values).agg(F.count(F.lit(1)).alias("_n"))
    reps = [F.struct(F.col(v).alias("v"),
                     F.concat_ws(sep, F.array_repeat(F.col(v), F.col("_n").cast("int"))).alias("r")).alias(f"_s{i}")
            for i, v in enumerate(values)]
    packed = per.select(key, *reps).groupBy(key).agg(
        *[F.collect_list(f"_s{i}").alias(f"_l{i}") for i in range(len(values))])
    return packed.select(key, *[F.array_join(F.array_sort(f"_l{i}")["r"], sep).alias(v) for i, v in enumerate(values)])


def project_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key, target, numerics with gaps, dirty categories, multi-value cells."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")

    lp = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    cells = (multivalue_cells(lp, "l_orderkey", ["p_type", "p_brand"])
             .withColumnRenamed("p_type", "part_types").withColumnRenamed("p_brand", "part_brands"))

    k = F.col("o_orderkey")
    base = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .join(cells, k == F.col("l_orderkey"), "left"))
    return base.select(
        k.alias("project_id"),
        F.col("o_totalprice").alias("effort"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("acct_balance"),
        F.when(k % 10 == 0, F.col("o_totalprice") / 1000.0).alias("sparse_metric"),
        F.year("o_orderdate").alias("order_year"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("part_types"),
        F.col("part_brands"),
    )


# The same frame as SQL text for the DuckDB oracle (tables are views there).
PROJECT_SQL = """
proj AS (
  WITH lp AS (
    SELECT l.l_orderkey, p.p_type, p.p_brand
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  ), cells AS (
    SELECT l_orderkey,
           string_agg(p_type, ';' ORDER BY p_type) AS part_types,
           string_agg(p_brand, ';' ORDER BY p_brand) AS part_brands
    FROM lp GROUP BY l_orderkey
  )
  SELECT o.o_orderkey AS project_id,
         o.o_totalprice AS effort,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS acct_balance,
         CASE WHEN o.o_orderkey % 10 = 0 THEN o.o_totalprice / 1000.0 END AS sparse_metric,
         CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
         NULLIF(o.o_orderpriority, '5-LOW') AS priority,
         ' ' || c.c_mktsegment || ' ' AS segment,
         o.o_orderstatus AS status,
         r.r_name AS region,
         n.n_name AS nation,
         cells.part_types,
         cells.part_brands
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN cells ON o.o_orderkey = cells.l_orderkey
)"""

# Raw (messy) headers of the project frame, as a source file would have them.
RAW_HEADERS = {
    "project_id": "Project ID",
    "effort": "Normalised Work Effort",
    "acct_balance": " Acct Balance",
    "sparse_metric": "Sparse Metric (k)",
    "order_year": "Order Year",
    "priority": "Order Priority",
    "segment": "Market Segment",
    "status": "Order Status",
    "region": "Region",
    "nation": "Nation",
    "part_types": "Part Types",
    "part_brands": "Part Brands",
}


def raw_project_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = project_frame(spark, sf_dir)
    return df.toDF(*[RAW_HEADERS[c] for c in df.columns])


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# Fixed values of the TPC-H-like test tables (levels that the oracle SQL lists).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
