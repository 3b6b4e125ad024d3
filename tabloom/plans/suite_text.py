"""Text and category cleaning queries (C01-C17) on dirty strings derived from
``part`` (and the project frame) by rules both engines repeat exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.operators.encode import ValueStandardizer, semicolon_columns
from tabloom.operators.profile import distinct_counts
from tabloom.plans import sqltext as T
from tabloom.plans.inputs import PROJECT_SQL, project_frame, table, with_sql
from tabloom.plans.registry import register

# ---------------------------------------------------------------------------
# Dirty text frame from ``part``: a multi-value cell with case, spaces, empty
# parts, duplicates, 'nan' parts and trailing punctuation, and a single value
# that exercises every token rule.
TOKEN_CASES = [
    ("{n} & {t}", "{n} & {t}"), ("{n} &/or {t}", "{n} &/or {t}"), ("{n}/{t}: {b}", "{n}/{t}: {b}"),
    ("{n} ({t})", "{n} ({t})"), ("{n} + {t}", "{n} + {t}"), ("stand alone", "stand alone"),
    ("web?", "web?"), ("psp {n}", "psp {n}"), ("{n}  jad", "{n}  jad"), ("client server", "client server"),
]


def _case_spark(k, n, t, b):
    out = None
    for i, (tmpl, _) in enumerate(TOKEN_CASES):
        parts = []
        rest = tmpl
        while rest:
            j = rest.find("{")
            if j < 0:
                parts.append(F.lit(rest)); break
            if j > 0:
                parts.append(F.lit(rest[:j]))
            key = rest[j + 1]
            parts.append({"n": n, "t": t, "b": b}[key])
            rest = rest[j + 3:]
        e = F.concat(*parts) if len(parts) > 1 else parts[0]
        out = F.when(k % len(TOKEN_CASES) == i, e) if out is None else out.when(k % len(TOKEN_CASES) == i, e)
    return out


def _case_sql(k, n, t, b):
    whens = []
    for i, (_, tmpl) in enumerate(TOKEN_CASES):
        s = "'" + tmpl.replace("{n}", "' || {N} || '").replace("{t}", "' || {T} || '").replace("{b}", "' || {B} || '") + "'"
        s = s.format(N=n, T=t, B=b)
        whens.append(f"WHEN {k} % {len(TOKEN_CASES)} = {i} THEN {s}")
    return "CASE " + " ".join(whens) + " END"


def dirty_frame(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cats = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ;"), F.col("p_type"), F.lit(" ; ; "),
                    F.lower("p_brand"), F.lit(". ;"), F.when(k % 3 == 0, F.lit("NaN;")).otherwise(F.lit("")),
                    F.col("p_type"), F.lit(" (x)"))
    return p.select(
        k.alias("key"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("nan")).otherwise(cats).alias("cats"),
        _case_spark(k, F.col("p_name"), F.lower("p_type"), F.lower("p_brand")).alias("token_text"),
        F.when(k % 9 == 0, F.lit("nan")).when(k % 10 == 0, F.lit(" ")).otherwise(
            F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("single"),
        F.when(k % 7 == 0, F.lit("NaN")).otherwise(F.lower("p_type")).alias("code"),
    )


DIRTY_SQL = f"""
dirty AS (
  SELECT p_partkey AS key,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'nan'
         ELSE ' ' || upper(p_name) || ' ;' || p_type || ' ; ; ' || lower(p_brand) || '. ;'
              || CASE WHEN p_partkey % 3 = 0 THEN 'NaN;' ELSE '' END || p_type || ' (x)' END AS cats,
    {_case_sql('p_partkey', 'p_name', 'lower(p_type)', 'lower(p_brand)')} AS token_text,
    CASE WHEN p_partkey % 9 = 0 THEN 'nan' WHEN p_partkey % 10 = 0 THEN ' ' ELSE '  ' || p_name || ' ' END AS single,
    CASE WHEN p_partkey % 7 = 0 THEN 'NaN' ELSE lower(p_type) END AS code
  FROM part
)"""

TEXT_COLS = ["priority", "segment", "status", "region", "nation", "part_types", "part_brands"]


@register("c01_normalize_text", with_sql(PROJECT_SQL) + f"""
SELECT project_id, effort, acct_balance, sparse_metric, order_year,
  {", ".join(f"{T.strip(f'lower({c})')} AS {c}" for c in TEXT_COLS)}
FROM proj""")
def c01_normalize_text(spark, sf_dir):
    return X.normalize_text(project_frame(spark, sf_dir))


@register("c01_normalize_text_legacy", with_sql(PROJECT_SQL) + f"""
SELECT project_id, {", ".join(f"coalesce({T.strip(f'lower({c})')}, 'nan') AS {c}" for c in TEXT_COLS)}
FROM proj""")
def c01_normalize_text_legacy(spark, sf_dir):
    """T1 legacy option: nulls become the text 'nan'."""
    df = project_frame(spark, sf_dir).select("project_id", *TEXT_COLS)
    return X.normalize_text(df, null_token="nan")


@register("c02_clean_values", with_sql(PROJECT_SQL) + f"""
SELECT project_id, {", ".join(f"{T.clean_value(c)} AS {c}" for c in TEXT_COLS)} FROM proj""")
def c02_clean_values(spark, sf_dir):
    return X.clean_values(project_frame(spark, sf_dir).select("project_id", *TEXT_COLS))


STD_MAP = {"machinery": "industrial", "1-urgent": "critical", "1_urgent": "critical_", "f": "finished"}


@register("c03_value_standardizer", with_sql(PROJECT_SQL) + f"""
SELECT project_id,
  {", ".join(f"CASE {' '.join(f'WHEN {T.strip(f"lower({c})")} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in STD_MAP.items())} ELSE {T.strip(f'lower({c})')} END AS {c}"
            for c in ['priority', 'segment', 'status', 'region', 'nation'])},
  part_types, part_brands
FROM proj""")
def c03_value_standardizer(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", *TEXT_COLS)
    return ValueStandardizer(STD_MAP).fit(df).transform(df)


@register("c04_clean_category", with_sql(DIRTY_SQL) + f"""
SELECT key, {T.clean_category('cats')} AS cats, {T.clean_category('token_text')} AS token_text FROM dirty""")
def c04_clean_category(spark, sf_dir):
    d = dirty_frame(spark, sf_dir)
    return d.select("key", X.clean_category("cats").alias("cats"), X.clean_category("token_text").alias("token_text"))


TIDY_MAP = {"economy": "budget", "brand#1": "brand#01"}


def _tidy_mapped_sql(e: str) -> str:
    mapped = "list_transform({p}, lambda x: CASE " + " ".join(
        f"WHEN x = '{k}' THEN '{v}'" for k, v in TIDY_MAP.items()) + " ELSE x END)"
    p = mapped.format(p=T.parts(f"lower({e})"))
    return (f"CASE WHEN {e} IS NULL OR {e} = '' THEN {e} ELSE "
            f"array_to_string(list_sort(list_distinct({p})), '; ') END")


@register("c05_tidy_multivalue", with_sql(DIRTY_SQL) + f"""
SELECT key, {T.tidy('cats')} AS tidy, {_tidy_mapped_sql('cats')} AS tidy_mapped FROM dirty""")
def c05_tidy_multivalue(spark, sf_dir):
    d = dirty_frame(spark, sf_dir)
    return d.select("key", X.tidy_multivalue("cats").alias("tidy"),
                    X.tidy_multivalue("cats", TIDY_MAP).alias("tidy_mapped"))


@register("c06_tidy_strict", with_sql(DIRTY_SQL) + f"""
SELECT key, {T.tidy_strict('cats')} AS strict, {T.tidy_strict('cats', True)} AS strict_std FROM dirty""")
def c06_tidy_strict(spark, sf_dir):
    d = dirty_frame(spark, sf_dir)
    return d.select("key", X.tidy_multivalue("cats", strict=True).alias("strict"),
                    X.tidy_multivalue("cats", strict=True, standardize=True).alias("strict_std"))


@register("c07_standardize_token", with_sql(DIRTY_SQL) + f"""
SELECT key, token_text, {T.standardize_token('token_text')} AS standardized FROM dirty""")
def c07_standardize_token(spark, sf_dir):
    d = dirty_frame(spark, sf_dir)
    return d.select("key", "token_text", X.standardize_token("token_text").alias("standardized"))


@register("c08_standardize_single", with_sql(DIRTY_SQL) + f"""
SELECT key, CASE WHEN lower({T.strip('single')}) IN ('', 'nan') THEN NULL
                 ELSE {T.standardize_token(f"lower({T.strip('single')})")} END AS single FROM dirty""")
def c08_standardize_single(spark, sf_dir):
    d = dirty_frame(spark, sf_dir)
    return d.select("key", X.standardize_single("single").alias("single"))


@register("c09_upper_code", with_sql(DIRTY_SQL) + f"""
SELECT key, NULLIF({T.strip('upper(code)')}, 'NAN') AS code FROM dirty""")
def c09_upper_code(spark, sf_dir):
    return dirty_frame(spark, sf_dir).select("key", X.upper_code("code").alias("code"))


@register("c10_clean_levels", with_sql(DIRTY_SQL) + f"""
SELECT DISTINCT {T.strip('code')} AS level FROM dirty
WHERE code IS NOT NULL AND lower({T.strip('code')}) NOT IN ('nan', 'none', '')""")
def c10_clean_levels(spark, sf_dir):
    from tabloom.operators.schema import q
    d = dirty_frame(spark, sf_dir)
    lv = X.strip_ws(q("code"))
    return d.where(q("code").isNotNull() & ~F.lower(lv).isin("nan", "none", "")).select(lv.alias("level")).distinct()


@register("c11_whitelist", with_sql(PROJECT_SQL) + """
SELECT project_id, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN priority ELSE 'Missing' END AS priority
FROM proj""")
def c11_whitelist(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    return df.select("project_id", X.whitelist("priority", ["1-URGENT", "2-HIGH"]).alias("priority"))


@register("c12_with_defaults", with_sql(PROJECT_SQL) + """
SELECT project_id, coalesce(acct_balance, 100.0) AS acct_balance, coalesce(priority, 'missing') AS priority,
       2024 AS year_of_project, 8 AS max_team_size
FROM proj""")
def c12_with_defaults(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "acct_balance", "priority")
    return X.with_defaults(df, {"acct_balance": 100.0, "priority": "missing", "year_of_project": 2024,
                                "max_team_size": 8})


@register("c13_multivalue_columns", with_sql(PROJECT_SQL) + f"""
SELECT * FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count_if(contains({c}, ';')) AS BIGINT) AS n_semicolon FROM proj" for c in TEXT_COLS)}
) WHERE n_semicolon >= 1""")
def c13_multivalue_columns(spark, sf_dir):
    df = project_frame(spark, sf_dir)
    cols = semicolon_columns(df, TEXT_COLS)
    from tabloom.operators.schema import q
    wide = df.agg(*[F.count_if(F.contains(q(c), F.lit(";"))).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_semicolon")


def _verify_sql(col: str) -> str:
    raw = f"string_split(v, ';')"
    stripped = f"list_transform({raw}, lambda x: {T.strip('x')})"
    return f"""SELECT '{col}' AS "column", CAST(count(*) AS BIGINT) AS n_values,
  CAST(count_if(contains(v, ';') AND {stripped} <> list_sort(list_distinct({stripped}))) AS BIGINT) AS n_unsorted_or_dup,
  CAST(count_if(contains(v, ';') AND NOT contains(v, '; ')) AS BIGINT) AS n_bad_separator,
  CAST(count_if(contains(v, ';') AND len(list_filter({raw}, lambda x: x <> {T.strip('x')})) > 0) AS BIGINT) AS n_untrimmed
FROM (SELECT DISTINCT {col} AS v FROM dirty2 WHERE {col} IS NOT NULL)"""


@register("c14_verify_multivalue", with_sql(DIRTY_SQL, f"""
dirty2 AS (SELECT key, {T.tidy('cats')} AS tidy, {T.clean_category('cats')} AS cleaned FROM dirty)""") + f"""
{_verify_sql('tidy')} UNION ALL {_verify_sql('cleaned')}""")
def c14_verify_multivalue(spark, sf_dir):
    from tabloom.operators.quality import verify_multivalue
    d = dirty_frame(spark, sf_dir).select(X.tidy_multivalue("cats").alias("tidy"),
                                          X.clean_category("cats").alias("cleaned"))
    return verify_multivalue(d, ["tidy", "cleaned"])


def _format_sql(col: str) -> str:
    from tabloom.functions.text import FORMAT_RULES
    return " UNION ALL ".join(
        f"SELECT '{col}' AS \"column\", '{name}' AS rule, CAST(count(*) AS BIGINT) AS n, min(v) AS sample "
        f"FROM (SELECT DISTINCT {col} AS v FROM dirty WHERE {col} IS NOT NULL) WHERE regexp_matches(v, '{rx}')"
        f" HAVING count(*) > 0" for name, rx in FORMAT_RULES)


@register("c15_format_issues", with_sql(DIRTY_SQL) + f"""
{_format_sql('token_text')} UNION ALL {_format_sql('single')}""")
def c15_format_issues(spark, sf_dir):
    from tabloom.operators.quality import format_issues
    return format_issues(dirty_frame(spark, sf_dir), ["token_text", "single"])


@register("c16_cleaning_effect", with_sql(DIRTY_SQL) + f"""
SELECT 'cats' AS "column", CAST(count(DISTINCT cats) AS BIGINT) AS n_before,
       CAST(count(DISTINCT {T.tidy_strict('cats')}) AS BIGINT) AS n_after FROM dirty
UNION ALL
SELECT 'token_text', CAST(count(DISTINCT token_text) AS BIGINT),
       CAST(count(DISTINCT {T.standardize_token('token_text')}) AS BIGINT) FROM dirty""")
def c16_cleaning_effect(spark, sf_dir):
    from tabloom.operators.quality import cleaning_effect
    d = dirty_frame(spark, sf_dir)
    after = d.select(X.tidy_multivalue("cats", strict=True).alias("cats"),
                     X.standardize_token("token_text").alias("token_text"))
    return cleaning_effect(d.select("cats", "token_text"), after, ["cats", "token_text"])


def _camel_sql(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"


@register("c17_pretty_name", f"""
WITH m AS (SELECT p_partkey AS key,
  'top_model_' || CAST(p_size AS VARCHAR) || '_' || {_camel_sql('p_name')} || '.pkl' AS file_name,
  replace(lower(p_name), ' ', '_') AS snake FROM part)
SELECT key, {T.strip(f"regexp_replace(regexp_replace(regexp_replace(file_name, '[.][^.]*$', ''), '^top_model_[0-9]+_', ''), '([A-Z])', ' \\1', 'g')")} AS display_name,
       array_to_string(list_transform(string_split(snake, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
FROM m""")
def c17_pretty_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    m = p.select(F.col("p_partkey").alias("key"),
                 F.concat(F.lit("top_model_"), F.col("p_size").cast("string"), F.lit("_"), camel, F.lit(".pkl"))
                 .alias("file_name"),
                 F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("snake"))
    return m.select("key", X.pretty_name("file_name").alias("display_name"), X.title_words("snake").alias("title"))
