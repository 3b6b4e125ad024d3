"""Multi-value column queries (G01-G16) on the project frame's semicolon cells.

Strategies whose new column names depend on the data (top-k, frequent values)
are checked in long form (key, new_column, flag): the Spark side unpivots the
operator's wide output, the SQL side recomputes the chosen values itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import multivalue as G
from tabloom.plans import sqltext as T
from tabloom.plans.inputs import PART_TYPES, PROJECT_SQL, project_frame, with_sql
from tabloom.plans.registry import ORACLES, register, rounded
from tabloom.session import materialize

HIERARCHY = {"ECONOMY": "cheap", "SMALL": "cheap", "PROMO": "cheap", "LARGE": "big", "STANDARD": "regular",
             "MEDIUM": "regular"}


def _vc_sql(col: str) -> str:
    return f"vc AS (SELECT v AS value, count(*) AS n FROM (SELECT unnest({T.parts(col)}) AS v FROM proj) GROUP BY 1)"


def _safe_sql(e: str) -> str:
    return f"replace(replace({e}, ' ', '_'), '-', '_')"


@register("g01_multivalue_stats", with_sql(PROJECT_SQL, _vc_sql("part_brands")) + f"""
SELECT 'part_brands' AS "column", (SELECT CAST(count(*) AS BIGINT) FROM vc) AS n_unique,
       CAST(sum(len({T.parts('part_brands')})) AS BIGINT) AS n_occurrences, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(min(len({T.parts('part_brands')})) AS INTEGER) AS min_per_row,
       CAST(max(len({T.parts('part_brands')})) AS INTEGER) AS max_per_row,
       round(avg(len({T.parts('part_brands')})), 6) AS mean_per_row,
       round(CAST(median(len({T.parts('part_brands')})) AS DOUBLE), 6) AS median_per_row
FROM proj WHERE part_brands IS NOT NULL""")
def g01_multivalue_stats(spark, sf_dir):
    return rounded(G.multivalue_stats(project_frame(spark, sf_dir), "part_brands"))


@register("g01_multivalue_top", with_sql(PROJECT_SQL, _vc_sql("part_brands")) + """
SELECT value, CAST(n AS BIGINT) AS n, round(n * 100.0 / (SELECT count(part_brands) FROM proj), 6) AS pct_rows
FROM vc ORDER BY n DESC, value LIMIT 15""")
def g01_multivalue_top(spark, sf_dir):
    return rounded(G.multivalue_top(project_frame(spark, sf_dir), "part_brands", 15))


@register("g02_frequency_of_frequencies", with_sql(PROJECT_SQL, _vc_sql("part_brands")) + """
SELECT CAST(n AS BIGINT) AS frequency, CAST(count(*) AS BIGINT) AS n_values FROM vc GROUP BY n""")
def g02_frequency_of_frequencies(spark, sf_dir):
    return G.frequency_of_frequencies(project_frame(spark, sf_dir), "part_brands")


@register("g03_multivalue_encoder", with_sql(PROJECT_SQL) + f"""
SELECT project_id, effort, priority,
  {", ".join(f'CAST(list_contains({T.parts("part_types")}, {chr(39)}{v}{chr(39)}) AS INTEGER) AS "part_types__{v}"' for v in PART_TYPES)}
FROM proj""")
def g03_multivalue_encoder(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "effort", "priority", "part_types", "part_brands")
    fitted = G.MultiValueEncoder(max_cardinality=10).fit(df, ["part_types", "part_brands"])
    return fitted.transform(df).drop("part_brands")


@register("g04_multivalue_encoder_preserve", with_sql(PROJECT_SQL) + f"""
SELECT project_id, part_types,
  {", ".join(f'CAST(list_contains({T.parts("part_types")}, {chr(39)}{v}{chr(39)}) AS INTEGER) AS "part_types__{v}"' for v in PART_TYPES)}
FROM proj""")
def g04_multivalue_encoder_preserve(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "part_types")
    return G.MultiValueEncoder(10, preserve=["part_types"]).fit(df, ["part_types"]).transform(df)


def _long_flags_sql(col: str, chosen_cte: str, prefix: str, rest: str) -> str:
    return with_sql(PROJECT_SQL, _vc_sql(col), chosen_cte, f"""
other AS (SELECT project_id, max(CASE WHEN t.value IS NULL THEN 1 ELSE 0 END) AS flag
          FROM (SELECT project_id, unnest({T.parts(col)}) AS v FROM proj) e LEFT JOIN chosen t ON e.v = t.value
          GROUP BY project_id)""") + f"""
SELECT p.project_id, '{col}_{prefix}' || {_safe_sql('c.value')} AS new_column,
       CAST(list_contains({T.parts('p.' + col)}, c.value) AS INTEGER) AS flag
FROM proj p CROSS JOIN chosen c
UNION ALL
SELECT p.project_id, '{col}_{rest}', CAST(coalesce(o.flag, 0) AS INTEGER) FROM proj p LEFT JOIN other o USING (project_id)"""


def _long(df, key, names):
    return df.select(key, *names).unpivot([key], list(names), "new_column", "flag").select(
        key, "new_column", F.col("flag").cast("int").alias("flag"))


@register("g05_multivalue_topk", _long_flags_sql(
    "part_brands", "chosen AS (SELECT value FROM vc ORDER BY n DESC, value LIMIT 5)", "top_", "other"))
def g05_multivalue_topk(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    cols, names = G.multivalue_topk(df, "part_brands", k=5)
    return _long(df.select("project_id", *cols), "project_id", names)


@register("g06_multivalue_frequent", _long_flags_sql(
    "part_brands", "chosen AS (SELECT value FROM vc WHERE n >= floor((SELECT count(*) FROM proj) * 0.16))",
    "freq_", "rare"))
def g06_multivalue_frequent(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    cols, names = G.multivalue_frequent(df, "part_brands", threshold=0.16)
    return _long(df.select("project_id", *cols), "project_id", names)


@register("g07_multivalue_counts", with_sql(PROJECT_SQL, _vc_sql("part_types"),
                                            "mc AS (SELECT value FROM vc ORDER BY n DESC, value LIMIT 1)", f"""
af AS (SELECT project_id, avg(vc.n) AS a FROM (SELECT project_id, unnest({T.parts('part_types')}) AS v FROM proj) e
       JOIN vc ON e.v = vc.value GROUP BY project_id)""") + f"""
SELECT p.project_id, CAST(len({T.parts('p.part_types')}) AS INTEGER) AS part_types_count,
       CAST(len(list_distinct({T.parts('p.part_types')})) AS INTEGER) AS part_types_unique_count,
       CAST(list_contains({T.parts('p.part_types')}, (SELECT value FROM mc)) AS INTEGER) AS part_types_has_most_common,
       round(coalesce(af.a, 0.0), 6) AS part_types_avg_frequency
FROM proj p LEFT JOIN af USING (project_id)""")
def g07_multivalue_counts(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "part_types")
    return rounded(G.multivalue_counts(df, "part_types").drop("part_types"))


@register("g07_multivalue_counts_join", with_sql(PROJECT_SQL, _vc_sql("part_types"), f"""
af AS (SELECT project_id, avg(vc.n) AS a FROM (SELECT project_id, unnest({T.parts('part_types')}) AS v FROM proj) e
       JOIN vc ON e.v = vc.value GROUP BY project_id)""") + """
SELECT p.project_id, round(coalesce(af.a, 0.0), 6) AS part_types_avg_frequency
FROM proj p LEFT JOIN af USING (project_id)""")
def g07_multivalue_counts_join(spark, sf_dir):
    """G07's mean of global counts alone."""
    df = project_frame(spark, sf_dir).select("project_id", "part_types")
    out = G.multivalue_counts(df, "part_types")
    return rounded(out.select("project_id", "part_types_avg_frequency"))


@register("g09_multivalue_groups", with_sql(PROJECT_SQL) + f"""
SELECT project_id,
  {", ".join(f'CAST(len(list_intersect({T.parts("part_types")}, [{", ".join(chr(39) + v + chr(39) for v, c in sorted(HIERARCHY.items()) if c == cat)}])) > 0 AS INTEGER) AS part_types_category_{cat}' for cat in sorted(set(HIERARCHY.values())))}
FROM proj""")
def g09_multivalue_groups(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    return df.select("project_id", *G.multivalue_groups("part_types", HIERARCHY))


def _rec_sql(col):
    return (f"SELECT '{col}' AS \"column\", CAST(count(*) AS BIGINT) AS n_unique, "
            "CASE WHEN count(*) > 100 THEN 'very_high' WHEN count(*) > 50 THEN 'high' ELSE 'moderate' END AS cardinality, "
            "CASE WHEN count(*) > 100 THEN 'count_features' WHEN count(*) > 50 THEN 'top_k' ELSE 'frequency_threshold' END AS recommended, "
            f"CAST(max(n) / min(n) > 100 AS INTEGER) AS skewed FROM (SELECT v AS value, count(*) AS n FROM "
            f"(SELECT unnest({T.parts(col)}) AS v FROM proj) GROUP BY 1)")


@register("g10_recommend_strategy", with_sql(PROJECT_SQL) + f"\n{_rec_sql('part_types')}\nUNION ALL\n{_rec_sql('part_brands')}")
def g10_recommend_strategy(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    return G.recommend_strategy(df, "part_types").unionByName(G.recommend_strategy(df, "part_brands"))


def _topk_processed(spark, sf_dir, k=5):
    df = materialize(project_frame(spark, sf_dir).select("project_id", "part_brands", "part_types"))
    vals = G.top_values(df, "part_brands", k)
    cols, names = G.multivalue_topk(df, "part_brands", values=vals)
    counts = G.multivalue_counts(df.select("project_id", "part_brands"), "part_brands")
    processed = df.select("*", *cols).join(counts.drop("part_brands"), "project_id")
    return df, processed, vals, names


def _expanded(spark, sf_dir, k=5):
    """part_brands by top-k flags and count features, and the joint mapping."""
    df = materialize(project_frame(spark, sf_dir).select("project_id", "part_brands", "part_types"))
    flags, m1 = G.expand_multivalue(df, ["part_brands"], "top_k", preserve=["part_brands"], k=k)
    out, m2 = G.expand_multivalue(flags, ["part_brands"], "count_features", preserve=["part_brands"])
    return df, out, m1.unionByName(m2.withColumn("position", F.col("position") + 100))


_TOP5 = "top AS (SELECT value FROM vc ORDER BY n DESC, value LIMIT 5)"


@register("g11_validate_flags", with_sql(PROJECT_SQL, _vc_sql("part_brands"), _TOP5, f"""
names AS (SELECT 'part_brands_top_' || {_safe_sql('value')} AS new_column, 'binary' AS kind FROM top
          UNION ALL VALUES ('part_brands_other', 'other'), ('part_brands_count', 'count'), ('part_brands_unique_count', 'unique_count'),
                           ('part_brands_has_most_common', 'binary'))""") + """
SELECT new_column, kind, (SELECT CAST(count(*) AS BIGINT) FROM proj) AS matches, (SELECT CAST(count(*) AS BIGINT) FROM proj) AS total,
       CAST(100.0 AS DOUBLE) AS match_rate FROM names""")
def g11_validate_flags(spark, sf_dir):
    """Every flag and count recomputed from the cells: binary, other and count kinds."""
    _, processed, mapping = _expanded(spark, sf_dir)
    return rounded(G.validate_flags(processed, "part_brands", G.checks_for(mapping, "part_brands")))


@register("g12_validate_rows", with_sql(PROJECT_SQL, _vc_sql("part_brands"), _TOP5, f"""
cells AS (SELECT project_id, part_brands, {T.parts('part_brands')} AS p FROM proj),
hit AS (SELECT c.project_id, string_agg(CAST(list_contains(c.p, t.value) AS INTEGER), '|' ORDER BY t.value) AS flags,
               sum(CAST(list_contains(c.p, t.value) AS INTEGER)) AS n FROM cells c CROSS JOIN top t GROUP BY c.project_id)""") + f"""
SELECT c.project_id AS key, c.part_brands AS original, array_to_string(c.p, '|') AS parsed, hit.flags,
       CAST(hit.n + (len(list_filter(c.p, lambda x: NOT list_contains(tops.tv, x))) > 0)::INTEGER AS INTEGER) AS n_set
FROM cells c JOIN hit USING (project_id), (SELECT list(value) AS tv FROM top) tops
ORDER BY {__import__('tabloom.functions.hashing', fromlist=['mix32_sql']).mix32_sql('c.project_id', 7)}, c.project_id LIMIT 5""")
def g12_validate_rows(spark, sf_dir):
    """Sampled rows with their flags (as one text here, since flag names depend on the data)."""
    df = materialize(project_frame(spark, sf_dir).select("project_id", "part_brands"))
    processed, mapping = G.expand_multivalue(df, ["part_brands"], "top_k", preserve=["part_brands"], k=5)
    new = [(r["kind"], r["captured"][0], r["new_column"]) for r in mapping.collect()]
    flags = [c for kind, _, c in sorted(new) if kind == "binary"]
    out = G.validate_rows(processed, "part_brands", [c for _, _, c in new], "project_id", n=5, seed=7)
    return out.select("key", "original", "parsed", F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in flags]).alias("flags"), "n_set")


@register("g13_validate_statistics", with_sql(PROJECT_SQL) + f"""
SELECT round(avg(len({T.parts('part_brands')})), 6) AS orig_mean, round(stddev_samp(len({T.parts('part_brands')})), 6) AS orig_std,
       round(avg(len({T.parts('part_brands')})), 6) AS count_mean, round(stddev_samp(len({T.parts('part_brands')})), 6) AS count_std,
       CAST(1.0 AS DOUBLE) AS count_corr, 0 AS non_binary_columns FROM proj""")
def g13_validate_statistics(spark, sf_dir):
    _, processed, vals, names = _topk_processed(spark, sf_dir)
    return rounded(G.validate_statistics(processed, "part_brands", "part_brands_count", names))


@register("g14_information_loss", with_sql(PROJECT_SQL, _vc_sql("part_brands"),
                                           "top AS (SELECT value FROM vc ORDER BY n DESC, value LIMIT 5)") + f"""
SELECT CAST((SELECT count(*) FROM vc WHERE value <> 'nan') AS BIGINT) AS n_unique,
       CAST((SELECT count(*) FROM vc WHERE value IN (SELECT value FROM top)) AS BIGINT) AS n_captured,
       round((SELECT count(*) FROM top) * 100.0 / (SELECT count(*) FROM vc WHERE value <> 'nan'), 6) AS capture_rate,
       (SELECT array_to_string(list_sort(list(value)), ', ') FROM
          (SELECT value FROM vc WHERE value NOT IN (SELECT value FROM top) ORDER BY value LIMIT 10)) AS lost_values,
       CAST((SELECT count(DISTINCT project_id) FROM (SELECT project_id, unnest({T.parts('part_brands')}) AS v FROM proj)
             WHERE v NOT IN (SELECT value FROM top)) AS BIGINT) AS rows_with_other""")
def g14_information_loss(spark, sf_dir):
    _, processed, vals, names = _topk_processed(spark, sf_dir)
    return rounded(G.information_loss(processed, "part_brands", vals, "part_brands_other"))


@register("g15_validation_summary", with_sql(PROJECT_SQL) + """
SELECT 'part_brands' AS "column", 10 AS n_new, 0 AS n_missing, 0 AS n_non_binary, 3 AS columns_before,
       13 AS columns_after""")
def g15_validation_summary(spark, sf_dir):
    df, processed, mapping = _expanded(spark, sf_dir)
    return G.validation_summary(df, processed, mapping)


@register("g16_expand_multivalue", _long_flags_sql(
    "part_brands", "chosen AS (SELECT value FROM vc ORDER BY n DESC, value LIMIT 3)", "top_", "other"))
def g16_expand_multivalue(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "part_brands")
    out, mapping = G.expand_multivalue(df, ["part_brands"], "top_k", k=3)
    names = [r["new_column"] for r in mapping.collect()]
    return _long(out, "project_id", names)


@register("g16_expand_frequency", _long_flags_sql(
    "part_brands", "chosen AS (SELECT value FROM vc WHERE n >= floor((SELECT count(*) FROM proj) * 0.16))", "freq_", "rare"))
def g16_expand_frequency(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "part_brands")
    out, mapping = G.expand_multivalue(df, ["part_brands"], "frequency_threshold", threshold=0.16)
    return _long(out, "project_id", [r["new_column"] for r in mapping.collect()])


@register("g16_expand_hierarchical", ORACLES["g09_multivalue_groups"])
def g16_expand_hierarchical(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "part_types")
    return G.expand_multivalue(df, ["part_types"], "hierarchical", hierarchy=HIERARCHY)[0]


@register("g16_expand_count_features", ORACLES["g07_multivalue_counts"])
def g16_expand_count_features(spark, sf_dir):
    df = materialize(project_frame(spark, sf_dir).select("project_id", "part_types"))
    return rounded(G.expand_multivalue(df, ["part_types"], "count_features")[0])


# --- G08: TF-IDF + PCA over part names per order --------------------------------
NAMES_SQL = """
names AS (SELECT l.l_orderkey AS project_id, string_agg(p.p_name, ';' ORDER BY p.p_name) AS part_names
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey)"""


def names_frame(spark, sf_dir):
    from tabloom.plans.inputs import multivalue_cells, table
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lp = li.join(pt, li.l_partkey == pt.p_partkey)
    return multivalue_cells(lp, "l_orderkey", ["p_name"]).select(
        F.col("l_orderkey").alias("project_id"), F.col("p_name").alias("part_names"))


@register("g08_tfidf_weights", with_sql(NAMES_SQL, r"""
docs AS (SELECT project_id, list_filter(regexp_split_to_array(lower(array_to_string(list_filter(regexp_split_to_array(
           regexp_replace(part_names, '^\s+|\s+$', '', 'g'), '\s*;\s*'), lambda x: x <> ''), ' ')), '[^a-z0-9_]+'),
           lambda x: length(x) >= 2) AS t
         FROM names),
nd AS (SELECT count(*) AS n FROM docs),
ex AS (SELECT project_id, unnest(t) AS term FROM docs),
st AS (SELECT term, count(*) AS tf, count(DISTINCT project_id) AS df FROM ex GROUP BY term),
vocab AS (SELECT term, df FROM st ORDER BY tf DESC, term LIMIT 100),
tfc AS (SELECT project_id, term, count(*) AS c FROM ex WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
w AS (SELECT project_id, term, c * (ln((1 + n) / (1 + df)) + 1) AS w FROM tfc JOIN vocab USING (term), nd)""") + """
SELECT project_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY project_id)), 6) AS weight FROM w""")
def g08_tfidf_weights(spark, sf_dir):
    """Non-zero L2-normalised tf-idf weights per order (long form)."""
    from tabloom.operators.tfidf import fit_tfidf
    df = materialize(names_frame(spark, sf_dir))
    fitted = fit_tfidf(df, "part_names", n_components=3)
    vocab = F.array(*[F.lit(v) for v in fitted.vocab])
    w = fitted.with_weights(df, ["project_id"]).select("project_id", F.inline("_w")).withColumnRenamed("x", "weight")
    return rounded(w.select("project_id", F.element_at(vocab, F.col("i") + 1).alias("term"), "weight"))


@register("g08_tfidf_pca")
def g08_tfidf_pca(spark, sf_dir):
    """PCA components of the tf-idf vectors (rows-only; tested against numpy)."""
    from tabloom.operators.tfidf import fit_tfidf
    df = materialize(names_frame(spark, sf_dir))
    fitted = fit_tfidf(df, "part_names", n_components=5)
    return fitted.transform(df, keep=["project_id"])
