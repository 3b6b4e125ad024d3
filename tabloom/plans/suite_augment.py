"""Set operations, sampling and augmentation queries.

Sample vs full: ``full`` is every project row; ``sample`` is the 2 % hash split
(K09, seed 5) with one market segment and one order status left out, so the
augmentation has categories to top up and an excluded column to respect.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32_sql
from tabloom.operators import augment as K
from tabloom.plans.inputs import PROJECT_SQL, project_frame, with_sql
from tabloom.plans.registry import register

COLS = ["segment", "nation", "priority"]
FULL_COLS = ["project_id", "segment", "nation", "priority", "status"]


def frames(spark, sf_dir):
    full = project_frame(spark, sf_dir).select(*FULL_COLS)
    sample = (K.split(full, 0.02, "project_id", seed=5).where(F.col("split") == "train").drop("split")
              .where((F.col("segment") != " MACHINERY ") & (F.col("status") != "P")))
    return sample, full


SETS_SQL = f"""
full_ AS (SELECT project_id, segment, nation, priority, status FROM proj),
sample AS (SELECT * FROM full_ WHERE {mix32_sql('project_id', 5)} % 10000 < 200
           AND segment <> ' MACHINERY ' AND status <> 'P'),
fp AS (SELECT project_id AS _key, "column", value FROM
       (UNPIVOT full_ ON {", ".join(COLS)} INTO NAME "column" VALUE value)),
sp AS (SELECT project_id AS _key, "column", value FROM
       (UNPIVOT sample ON {", ".join(COLS)} INTO NAME "column" VALUE value)),
missing AS (SELECT DISTINCT "column", value FROM fp EXCEPT SELECT DISTINCT "column", value FROM sp)"""


@register("k01_missing_categories", with_sql(PROJECT_SQL, SETS_SQL) + "\nSELECT \"column\", value FROM missing")
def k01_missing_categories(spark, sf_dir):
    sample, full = frames(spark, sf_dir)
    return K.missing_categories(sample, full, COLS)


@register("k01_missing_category_stats", with_sql(PROJECT_SQL, SETS_SQL) + """
SELECT f."column", CAST(f.n AS BIGINT) AS total_in_full, CAST(coalesce(s.n, 0) AS BIGINT) AS in_sample,
       CAST(coalesce(m.n, 0) AS BIGINT) AS missing_count
FROM (SELECT "column", count(DISTINCT value) AS n FROM fp GROUP BY 1) f
LEFT JOIN (SELECT "column", count(DISTINCT value) AS n FROM sp GROUP BY 1) s USING ("column")
LEFT JOIN (SELECT "column", count(*) AS n FROM missing GROUP BY 1) m USING ("column")""")
def k01_missing_category_stats(spark, sf_dir):
    sample, full = frames(spark, sf_dir)
    return K.missing_category_stats(sample, full, COLS)


COVER_SQL = f"""
ranked AS (SELECT fp._key, row_number() OVER (PARTITION BY fp."column", fp.value
                  ORDER BY {mix32_sql('fp._key', 42)}, fp._key) AS r
           FROM fp JOIN missing USING ("column", value)),
picked AS (SELECT DISTINCT _key FROM ranked WHERE r <= 5),
added AS (SELECT DISTINCT * FROM full_ WHERE project_id IN (SELECT _key FROM picked)
          AND (status IS NULL OR status IN (SELECT status FROM sample WHERE status IS NOT NULL)))"""


@register("k02_cover_categories", with_sql(PROJECT_SQL, SETS_SQL, COVER_SQL) + """
SELECT * FROM sample UNION ALL SELECT * FROM added""", headline=True)
def k02_cover_categories(spark, sf_dir):
    sample, full = frames(spark, sf_dir)
    enhanced, _ = K.cover_categories(sample, full, COLS, "project_id", n=5, exclude=["status"], seed=42)
    return enhanced


@register("k03_added_rows", with_sql(PROJECT_SQL, SETS_SQL, COVER_SQL) + "\nSELECT * FROM added")
def k03_added_rows(spark, sf_dir):
    sample, full = frames(spark, sf_dir)
    return K.cover_categories(sample, full, COLS, "project_id", n=5, exclude=["status"], seed=42)[1]


@register("k04_category_coverage", with_sql(PROJECT_SQL, SETS_SQL, COVER_SQL, f"""
enh AS (SELECT * FROM sample UNION ALL SELECT * FROM added),
ep AS (SELECT "column", value FROM (UNPIVOT enh ON {", ".join(COLS)} INTO NAME "column" VALUE value)),
nv AS (SELECT DISTINCT "column", value FROM ep EXCEPT SELECT DISTINCT "column", value FROM sp)""") + """
SELECT a."column", CAST(coalesce(b.n, 0) AS BIGINT) AS n_before, CAST(a.n AS BIGINT) AS n_after,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_new, nv.value AS new_value
FROM (SELECT "column", count(DISTINCT value) AS n FROM ep GROUP BY 1) a
LEFT JOIN (SELECT "column", count(DISTINCT value) AS n FROM sp GROUP BY 1) b USING ("column")
LEFT JOIN (SELECT "column", count(*) AS n FROM nv GROUP BY 1) k USING ("column")
LEFT JOIN nv USING ("column")""")
def k04_category_coverage(spark, sf_dir):
    """Category counts before and after, with a row for every new value."""
    sample, full = frames(spark, sf_dir)
    enhanced, _ = K.cover_categories(sample, full, COLS, "project_id", n=5, exclude=["status"], seed=42)
    new = K.new_categories(sample, enhanced, COLS).withColumnRenamed("value", "new_value")
    return K.category_coverage(sample, enhanced, COLS).join(new, "column", "left")


@register("k05_enhance")
def k05_enhance(spark, sf_dir):
    """Whole enhancement flow: clean both sides with a plan fitted on the full
    table, top up the sample, encode with the same plan (rows-only check)."""
    return _enhanced(spark, sf_dir).encoded


def _enhanced(spark, sf_dir):
    from tabloom.plans.enhance import enhance
    from tabloom.plans.inputs import raw_project_frame
    from tabloom.session import materialize
    full = materialize(raw_project_frame(spark, sf_dir))
    sample = K.split(full, 0.02, "Project ID", seed=5).where(F.col("split") == "train").drop("split")
    sample = sample.where(F.lower(F.trim(F.col("Market Segment"))) != "machinery")
    return enhance(sample, full, ["market_segment", "nation"], "project_id", "normalised_work_effort", n=5, seed=42)


@register("k05_enhance_coverage")
def k05_enhance_coverage(spark, sf_dir):
    """Categories of the sample before and after the top-up, on cleaned values."""
    return _enhanced(spark, sf_dir).coverage


@register("k07_semi_filter", with_sql(PROJECT_SQL, SETS_SQL) + """
SELECT * FROM full_ WHERE segment IN (SELECT segment FROM sample) OR segment IS NULL""")
def k07_semi_filter(spark, sf_dir):
    sample, full = frames(spark, sf_dir)
    return K.semi_filter(full, sample, "segment")


@register("k08_sample_n", with_sql(PROJECT_SQL) + f"""
SELECT project_id, segment, nation FROM proj ORDER BY {mix32_sql('project_id', 11)}, project_id LIMIT 100""")
def k08_sample_n(spark, sf_dir):
    return K.sample_n(project_frame(spark, sf_dir).select("project_id", "segment", "nation"), 100, "project_id", 11)


@register("k09_split", with_sql(PROJECT_SQL) + f"""
SELECT project_id, CASE WHEN {mix32_sql('project_id', 123)} % 10000 < 8000 THEN 'train' ELSE 'holdout' END AS split
FROM proj""")
def k09_split(spark, sf_dir):
    return K.split(project_frame(spark, sf_dir).select("project_id"), 0.8, "project_id", seed=123)


@register("k10_folds", with_sql(PROJECT_SQL) + f"""
SELECT project_id, CAST({mix32_sql('project_id', 123)} % 10 AS INTEGER) AS fold FROM proj""")
def k10_folds(spark, sf_dir):
    return K.folds(project_frame(spark, sf_dir).select("project_id"), 10, "project_id", seed=123)


@register("k11_append", with_sql(PROJECT_SQL) + """
SELECT project_id, effort, NULL::VARCHAR AS priority FROM proj WHERE status = 'F'
UNION ALL SELECT project_id, NULL::DOUBLE, priority FROM proj WHERE status <> 'F'""")
def k11_append(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    a = df.where(F.col("status") == "F").select("project_id", "effort")
    b = df.where(F.col("status") != "F").select("project_id", "priority")
    return K.append(a, b)
