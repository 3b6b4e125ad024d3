"""Encoding (H01-H09) and domain feature (J01-J10) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import domain as J
from tabloom.operators import encode as H
from tabloom.plans import sqltext as T
from tabloom.plans.inputs import (PRIORITIES, PROJECT_SQL, REGIONS, SEGMENTS, STATUSES, project_frame, with_sql)
from tabloom.plans.registry import register, rounded


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# --- H ----------------------------------------------------------------------
ONEHOT_COLS = {"priority": sorted(PRIORITIES[:4]), "segment": sorted(f" {s} " for s in SEGMENTS),
               "status": STATUSES, "region": REGIONS}


def _onehot_sql(drop_first=False, preserve=()):
    flags = []
    for c, levels in ONEHOT_COLS.items():
        for v in (levels[1:] if drop_first else levels):
            flags.append(f"{T.flag(f'{c} = {_lit(v)}')} AS {_q(f'{c}_{v}')}")
    keep = ["project_id", "effort", "nation"] + list(preserve)
    return with_sql(PROJECT_SQL) + f"\nSELECT {', '.join(keep)}, {', '.join(flags)} FROM proj"


def _onehot_input(spark, sf_dir):
    return project_frame(spark, sf_dir).select("project_id", "effort", "priority", "segment", "status", "region", "nation")


@register("h01_one_hot", _onehot_sql(), headline=True)
def h01_one_hot(spark, sf_dir):
    df = _onehot_input(spark, sf_dir)
    return H.OneHot(max_cardinality=10).fit(df).transform(df)


@register("h01_one_hot_drop_first", _onehot_sql(drop_first=True))
def h01_one_hot_drop_first(spark, sf_dir):
    df = _onehot_input(spark, sf_dir)
    return H.OneHot(max_cardinality=10, drop_first=True).fit(df).transform(df)


@register("h02_one_hot_preserve", _onehot_sql(preserve=["priority", "region"]))
def h02_one_hot_preserve(spark, sf_dir):
    df = _onehot_input(spark, sf_dir)
    return H.OneHot(max_cardinality=10, preserve=["priority", "region"]).fit(df).transform(df)


LABEL_LEVELS = sorted(PRIORITIES[:4] + [H.MISSING_TOKEN])


@register("h03_label_codes", with_sql(PROJECT_SQL) + f"""
SELECT project_id, CAST(list_position([{", ".join(_lit(v) for v in LABEL_LEVELS)}], coalesce(priority, '{H.MISSING_TOKEN}')) - 1 AS INTEGER) AS priority,
       CAST(list_position([{", ".join(_lit(v) for v in sorted(STATUSES))}], status) - 1 AS INTEGER) AS status
FROM proj""")
def h03_label_codes(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "priority", "status")
    return H.LabelEncoder().fit(df, ["priority", "status"]).codes(df)


@register("h03_label_one_hot", with_sql(PROJECT_SQL) + f"""
SELECT project_id, {", ".join(f"CAST(coalesce(priority, '{H.MISSING_TOKEN}') = {_lit(v)} AS INTEGER) AS {_q('priority_' + v)}" for v in LABEL_LEVELS)}
FROM proj""")
def h03_label_one_hot(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "priority")
    return H.LabelEncoder().fit(df, ["priority"]).one_hot(df)


DECODE_GROUPS = {"priority_label": {v.lower(): f"priority_{v}" for v in PRIORITIES[:4]},
                 "region_label": {v.lower(): f"region_{v}" for v in REGIONS}}


@register("h04_decode_flags", with_sql(PROJECT_SQL) + """
SELECT project_id, effort, nation, coalesce(lower(priority), 'missing') AS priority_label,
       lower(region) AS region_label
FROM proj""")
def h04_decode_flags(spark, sf_dir):
    """Flags back to labels: the one-hot frame decoded round-trips to the input."""
    df = _onehot_input(spark, sf_dir)
    flags = H.OneHot(10).fit(df).transform(df)
    out = H.decode_flags(flags, DECODE_GROUPS, default="missing")
    return out.select("project_id", "effort", "nation", "priority_label", "region_label")


PART_TYPE_FLAGS = {"types_first": {t.lower(): f"part_types__{t}" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO",
                                                                        "SMALL", "STANDARD"]}}


@register("h04_decode_first_match", with_sql(PROJECT_SQL) + f"""
SELECT project_id, CASE {" ".join(f"WHEN list_contains({T.parts('part_types')}, '{t}') THEN '{t.lower()}'" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])} ELSE 'Missing' END AS types_first,
  coalesce(nullif(array_to_string(list_transform(list_sort(list_distinct({T.parts('part_types')})), lambda x: lower(x)), ';'), ''), 'missing') AS types_all
FROM proj""")
def h04_decode_first_match(spark, sf_dir):
    from tabloom.operators.multivalue import MultiValueEncoder
    df = project_frame(spark, sf_dir).select("project_id", "part_types")
    flags = MultiValueEncoder(10).fit(df, ["part_types"]).transform(df)
    first = H.decode_flags(flags, PART_TYPE_FLAGS, default="Missing", first_match=True, keep_flags=True)
    both = H.decode_flags(first, {"types_all": PART_TYPE_FLAGS["types_first"]}, default="missing")
    return both.select("project_id", "types_first", "types_all")


APP_RULES = [("web", "app_web"), ("mobile", "app_mobile"), ("desktop", "app_desktop")]
APP_FLAGS = ["app_other", "app_web", "app_mobile", "app_desktop"]


def _cycle(key, values):
    """Spark expr choosing values[key % n] (None = null)."""
    n = len(values)
    e = None
    for i, v in enumerate(values):
        e = F.when(F.col(key) % n == i, F.lit(v)) if e is None else e.when(F.col(key) % n == i, F.lit(v))
    return e


def _cycle_sql(key, values):
    n = len(values)
    return "CASE " + " ".join(f"WHEN {key} % {n} = {i} THEN {'NULL' if v is None else _lit(v)}"
                              for i, v in enumerate(values)) + " END"


FORM_VALUES = {
    "relative_size": ["XS", "Small", "Medium", "Large", "XL", "Extra Large", None],
    "application_type": ["Web Application", "Mobile App", "Desktop Tool", "Financial API", "Business System"],
    "development_type": ["New Development", "Enhancement", "Maintenance", "Re-development"],
    "development_platform": ["Cloud", "Multi-platform", "Mainframe"],
    "language_type": ["Object-Oriented", "3GL", "4GL", "Scripting"],
    "architecture": ["Microservices", "Client server", "Stand alone"],
    "organisation_type": ["Large Enterprise", "Banking", "Government", "Retail"],
    "industry_sector": ["Technology", "Banking", "Healthcare", "Manufacturing", "Government", "Retail"],
    "programming_language": ["Python", "Java", "JavaScript", "C#", "PHP", "Ruby", "C++", "C", "Go"],
}


def form_frame(spark, sf_dir):
    """Scoring-form inputs per project (numbers from the data, texts cycled by key)."""
    df = project_frame(spark, sf_dir)
    k = F.col("project_id")
    cols = [k, F.col("order_year").alias("year_of_project"),
            F.when(k % 17 == 0, F.lit(None)).otherwise((k % 13).cast("int")).alias("max_team_size"),
            (F.col("effort") / 1000).alias("functional_size")]
    cols += [_cycle("project_id", v).alias(n) for n, v in FORM_VALUES.items()]
    return df.select(*cols)


FORM_SQL = "form AS (SELECT project_id, order_year AS year_of_project, " \
           "CASE WHEN project_id % 17 = 0 THEN NULL ELSE CAST(project_id % 13 AS INTEGER) END AS max_team_size, " \
           "effort / 1000 AS functional_size, " + ", ".join(
               f"{_cycle_sql('project_id', v)} AS {n}" for n, v in FORM_VALUES.items()) + " FROM proj)"


def _num_or_lit(v) -> str:
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else _lit(v)


def _rules_sql(e: str, rules, default) -> str:
    s = f"upper(coalesce(CAST({e} AS VARCHAR), ''))"
    whens = []
    for any_of, none_of, value in rules:
        cond = "(" + " OR ".join(f"contains({s}, {_lit(k)})" for k in any_of) + ")"
        for k in none_of:
            cond += f" AND NOT contains({s}, {_lit(k)})"
        whens.append(f"WHEN {cond} THEN {_num_or_lit(value)}")
    d = "NULL" if default is None else _num_or_lit(default)
    return f"(CASE {' '.join(whens)} ELSE {d} END)"


@register("h05_activate_group", with_sql(PROJECT_SQL, FORM_SQL) + f"""
, chosen AS (SELECT project_id, application_type,
   CASE WHEN contains(lower(application_type), 'web') THEN 'app_web'
        WHEN contains(lower(application_type), 'mobile') THEN 'app_mobile'
        WHEN contains(lower(application_type), 'desktop') THEN 'app_desktop' ELSE 'app_other' END AS c FROM form)
SELECT project_id, application_type, {", ".join(f"CAST(c = '{f}' AS INTEGER) AS {f}" for f in APP_FLAGS)} FROM chosen""")
def h05_activate_group(spark, sf_dir):
    df = form_frame(spark, sf_dir).select("project_id", "application_type")
    return H.activate_group(df, "application_type", APP_RULES, APP_FLAGS, default="app_other")


GROUP_FLAGS = ["project_prf_application_group_business_application", "project_prf_application_group_nan",
               "project_prf_development_type_enhancement", "project_prf_development_type_new_development", "project_prf_development_type_other",
               "project_prf_relative_size_l", "project_prf_relative_size_m1", "project_prf_relative_size_xl", "project_prf_relative_size_nan",
               "external_eef_data_quality_rating_b", "external_eef_data_quality_rating_a", "tech_tf_web_yes", "tech_tf_web_no"]


@register("h05_activate_groups", with_sql(PROJECT_SQL) + """
, f AS (SELECT project_id,
  upper(coalesce(CASE project_id % 4 WHEN 0 THEN 'Web shop' WHEN 1 THEN 'business system' WHEN 3 THEN region END, '')) AS app,
  upper(coalesce(CASE project_id % 3 WHEN 0 THEN 'New one' WHEN 1 THEN 'Enhancement' ELSE segment END, '')) AS dev,
  upper(coalesce(CASE project_id % 6 WHEN 0 THEN 'Large' WHEN 1 THEN 'XLarge' WHEN 2 THEN 'medium 1' WHEN 3 THEN 'XL' WHEN 4 THEN 'Small'
                 ELSE priority END, '')) AS size FROM proj)
SELECT project_id,
  CAST(contains(app, 'WEB') OR contains(app, 'BUSINESS') AS INTEGER) AS project_prf_application_group_business_application,
  CAST(NOT (contains(app, 'WEB') OR contains(app, 'BUSINESS')) AS INTEGER) AS project_prf_application_group_nan,
  CAST(contains(dev, 'ENHANCEMENT') AND NOT contains(dev, 'NEW') AS INTEGER) AS project_prf_development_type_enhancement,
  CAST(contains(dev, 'NEW') AS INTEGER) AS project_prf_development_type_new_development,
  CAST(NOT contains(dev, 'NEW') AND NOT contains(dev, 'ENHANCEMENT') AS INTEGER) AS project_prf_development_type_other,
  CAST(NOT contains(size, 'MEDIUM') AND ((contains(size, 'LARGE') AND NOT contains(size, 'XL'))
       OR (contains(size, 'SMALL') AND NOT contains(size, 'XS'))) AS INTEGER) AS project_prf_relative_size_l,
  CAST(contains(size, 'MEDIUM') AS INTEGER) AS project_prf_relative_size_m1,
  CAST(contains(size, 'XL') AND NOT contains(size, 'MEDIUM') AS INTEGER) AS project_prf_relative_size_xl,
  CAST(NOT (contains(size, 'MEDIUM') OR contains(size, 'LARGE') OR contains(size, 'SMALL') OR contains(size, 'XL') OR contains(size, 'XS')) AS INTEGER) AS project_prf_relative_size_nan,
  CAST(1 AS INTEGER) AS external_eef_data_quality_rating_b, CAST(0 AS INTEGER) AS external_eef_data_quality_rating_a,
  CAST(0 AS INTEGER) AS tech_tf_web_yes, CAST(1 AS INTEGER) AS tech_tf_web_no
FROM f""")
def h05_activate_groups(spark, sf_dir):
    """One flag of each group switched on from raw inputs by the groups' rules. A rule's
    word may stand anywhere in a flag's name, so "s" and "a" find the first flag."""
    p = project_frame(spark, sf_dir)
    k = F.col("project_id")
    return H.activate_groups(p.select(
        "project_id",
        F.when(k % 4 == 0, "Web shop").when(k % 4 == 1, "business system").when(k % 4 == 3, F.col("region")).alias("project_prf_application_type"),
        F.when(k % 3 == 0, "New one").when(k % 3 == 1, "Enhancement").otherwise(F.col("segment")).alias("project_prf_development_type"),
        F.when(k % 6 == 0, "Large").when(k % 6 == 1, "XLarge").when(k % 6 == 2, "medium 1").when(k % 6 == 3, "XL").when(k % 6 == 4, "Small")
        .otherwise(F.col("priority")).alias("project_prf_relative_size")), GROUP_FLAGS).select("project_id", *GROUP_FLAGS)


RANGE_KINDS = {"effort": "continuous", "order_year": "discrete", "acct_balance": "continuous"}


def _range_sql(inverse=False):
    lo = {c: f"(SELECT min({c}) FROM proj)" for c in RANGE_KINDS}
    hi = {c: f"(SELECT max({c}) FROM proj)" for c in RANGE_KINDS}
    out = []
    for c, kind in RANGE_KINDS.items():
        if kind == "discrete":
            v = f"least(greatest((coalesce(CAST({c} AS DOUBLE), {lo[c]}) - {lo[c]}) / (({hi[c]} - {lo[c]}) + 1e-8), -1.0), 1.0)"
            if inverse:
                v = f"CAST(round(least(greatest({v}, -1.0), 1.0) * ({hi[c]} - {lo[c]}) + {lo[c]}) AS BIGINT)"
        else:
            v = f"(coalesce({c}, 0.0) - {lo[c]}) * (2.0 / ({hi[c]} - {lo[c]})) + -1.0"
            if inverse:
                v = f"((least(greatest({v}, -1.0), 1.0) - -1.0) * (({hi[c]} - {lo[c]}) / 2.0) + {lo[c]})"
        out.append(f"round({v}, 6) AS {c}" if not (inverse and kind == "discrete") else f"{v} AS {c}")
    return with_sql(PROJECT_SQL) + f"\nSELECT project_id, {', '.join(out)} FROM proj"


@register("h06_range_scaler", _range_sql())
def h06_range_scaler(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", *RANGE_KINDS)
    return rounded(H.RangeScaler().fit(df, RANGE_KINDS).transform(df))


@register("h07_range_inverse", _range_sql(inverse=True))
def h07_range_inverse(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", *RANGE_KINDS)
    fitted = H.RangeScaler().fit(df, RANGE_KINDS)
    return rounded(fitted.inverse(fitted.transform(df)))


@register("h07_argmax_level", with_sql(PROJECT_SQL) + """
SELECT project_id, priority FROM proj""")
def h07_argmax_level(spark, sf_dir):
    """Categorical inverse: label one-hot back to the level by arg-max; token -> null."""
    df = project_frame(spark, sf_dir).select("project_id", "priority")
    fitted = H.LabelEncoder().fit(df, ["priority"])
    oh = fitted.one_hot(df)
    levels = fitted.categories["priority"]
    return oh.select("project_id", H.argmax_level([f"priority_{v}" for v in levels], levels).alias("priority"))


@register("h08_zscore", with_sql(PROJECT_SQL) + """
SELECT project_id, round((effort - (SELECT avg(effort) FROM proj)) / (SELECT stddev_pop(effort) FROM proj), 6) AS effort,
       round((acct_balance - (SELECT avg(acct_balance) FROM proj)) / (SELECT stddev_pop(acct_balance) FROM proj), 6) AS acct_balance
FROM proj""")
def h08_zscore(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "effort", "acct_balance")
    return rounded(H.fit_zscore(df, ["effort", "acct_balance"]).transform(df))


@register("h09_minmax", with_sql(PROJECT_SQL) + """
SELECT project_id, round((effort - (SELECT min(effort) FROM proj)) / ((SELECT max(effort) FROM proj) - (SELECT min(effort) FROM proj)), 6) AS effort,
       round((acct_balance - (SELECT min(acct_balance) FROM proj)) / ((SELECT max(acct_balance) FROM proj) - (SELECT min(acct_balance) FROM proj)), 6) AS acct_balance
FROM proj""")
def h09_minmax(spark, sf_dir):
    df = project_frame(spark, sf_dir).select("project_id", "effort", "acct_balance")
    return rounded(H.fit_minmax(df, ["effort", "acct_balance"]).transform(df))


# --- J ----------------------------------------------------------------------
@register("j01_bucketize", with_sql(PROJECT_SQL, FORM_SQL) + """
SELECT project_id, CASE WHEN max_team_size IS NULL THEN NULL WHEN max_team_size <= 1 THEN '1'
  WHEN max_team_size <= 3 THEN '2-3' WHEN max_team_size <= 5 THEN '4-5' WHEN max_team_size <= 10 THEN '6-10'
  ELSE '11+' END AS team_size_group FROM form""")
def j01_bucketize(spark, sf_dir):
    return form_frame(spark, sf_dir).select("project_id", J.bucketize("max_team_size").alias("team_size_group"))


J02_OUT = {"development_type_code": ("development_type", J.DEV_TYPE, "Missing"),
           "platform_code": ("development_platform", J.PLATFORM, "Missing"),
           "language_type_code": ("language_type", J.LANGUAGE_TYPE, "Missing"),
           "size_code": ("relative_size", J.SIZE_CODE, "Missing"),
           "organisation_code": ("organisation_type", J.ORGANISATION, "Missing"),
           "size_factor": ("relative_size", J.SIZE_FACTOR, 1.0)}


@register("j02_keyword_code", with_sql(PROJECT_SQL, FORM_SQL) + "\nSELECT project_id, " + ", ".join(
    f"{_rules_sql(src, rules, d)} AS {name}" for name, (src, rules, d) in J02_OUT.items()) + " FROM form")
def j02_keyword_code(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    return f.select("project_id", *[J.keyword_code(src, rules, d).alias(name) for name, (src, rules, d) in J02_OUT.items()])


J03_OUT = {"application_group": ("application_type", J.APP_GROUP, "Missing"),
           "application_type_top": ("application_type", J.APP_TYPE_TOP, "Missing"),
           "web_development": ("application_type", J.WEB_DEV, "Missing"),
           "architecture_code": ("architecture", J.ARCHITECTURE, "Missing"),
           "clientserver_description": ("architecture", J.CLIENT_SERVER_DESC, "Missing")}


@register("j03_keyword_codes", with_sql(PROJECT_SQL, FORM_SQL) + "\nSELECT project_id, " + ", ".join(
    f"{_rules_sql(src, rules, d)} AS {name}" for name, (src, rules, d) in J03_OUT.items()) + " FROM form")
def j03_keyword_codes(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    app = J.keyword_codes("application_type", {k: (r, d) for k, (s, r, d) in J03_OUT.items() if s == "application_type"})
    arch = J.keyword_codes("architecture", {k: (r, d) for k, (s, r, d) in J03_OUT.items() if s == "architecture"})
    return f.select("project_id", *app, *arch)


EFFORT_SQL = (f"200.0 * coalesce(CAST(max_team_size AS DOUBLE), 5.0) * {_rules_sql('relative_size', J.SIZE_FACTOR, 1.0)} "
              f"* {_rules_sql('application_type', J.APP_FACTOR, 1.0)} * {_rules_sql('development_type', J.DEV_FACTOR, 1.0)} / 1000.0")


@register("j04_estimate_effort", with_sql(PROJECT_SQL, FORM_SQL) + f"""
SELECT project_id, round({EFFORT_SQL}, 6) AS estimated_effort FROM form""")
def j04_estimate_effort(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    e = J.estimate_effort("max_team_size", "relative_size", "application_type", "development_type")
    return rounded(f.select("project_id", e.alias("estimated_effort")))


@register("j05_validate_rows_rules", with_sql(PROJECT_SQL, FORM_SQL) + """
, v AS (SELECT project_id, functional_size AS target, max_team_size,
  list_filter([CASE WHEN year_of_project IS NULL THEN 'missing: year_of_project' END,
               CASE WHEN max_team_size IS NULL THEN 'missing: max_team_size' END,
               CASE WHEN max_team_size <= 0 THEN 'Team size must be positive' END], lambda x: x IS NOT NULL) AS e,
  list_filter([CASE WHEN functional_size <= 0 THEN 'Target value is zero or negative'
                    WHEN functional_size > 10 THEN 'Target value seems very high (>10)' END,
               CASE WHEN max_team_size > 50 THEN 'Very large team size (>50)' END], lambda x: x IS NOT NULL) AS w
  FROM form)
SELECT project_id, len(e) = 0 AS valid, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings FROM v""")
def j05_validate_rows_rules(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    out = J.validate_row_rules(f, ["year_of_project", "max_team_size"], "max_team_size", "functional_size")
    return out.select("project_id", "valid", "errors", "warnings")


J06_COLS = ["year_of_project", "max_team_size", "functional_size", "relative_size", "application_type",
            "industry_sector"]


@register("j06_feature_counts", with_sql(PROJECT_SQL, FORM_SQL) + f"""
SELECT project_id, 6 AS total_features, 3 AS numeric_features, 3 AS categorical_features,
  {" + ".join(f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = 'Missing' THEN 1 ELSE 0 END" for c in J06_COLS)} AS missing_values
FROM form""")
def j06_feature_counts(spark, sf_dir):
    f = form_frame(spark, sf_dir).select("project_id", *J06_COLS)
    out = J.feature_counts(f, J06_COLS)
    return out.select("project_id", "total_features", "numeric_features", "categorical_features", "missing_values")


@register("j07_effort_units", with_sql(PROJECT_SQL, FORM_SQL) + """
SELECT project_id, effort / 100 / 8 AS days, effort / 100 / 8 / 5 AS weeks,
       effort / 100 / 8 / 5 / 4.33 AS months,
       CASE WHEN max_team_size > 0 THEN effort / 100 / max_team_size ELSE effort / 100 END AS per_person,
       CASE WHEN effort / 100 < 10 THEN 'low' WHEN effort / 100 > 5000 THEN 'high' END AS warning
FROM form JOIN (SELECT project_id, effort FROM proj) USING (project_id)""")
def j07_effort_units(spark, sf_dir):
    f = form_frame(spark, sf_dir).join(project_frame(spark, sf_dir).select("project_id", "effort"), "project_id")
    return f.select("project_id", *J.effort_units(F.col("effort") / 100, F.col("max_team_size")))


@register("j08_month_split", with_sql(PROJECT_SQL, FORM_SQL) + """
SELECT project_id, CAST(floor(functional_size) AS INTEGER) AS whole_months,
       CAST(floor((functional_size - CAST(floor(functional_size) AS INTEGER)) * 30) AS INTEGER) AS remaining_days,
       CASE WHEN max_team_size = 0 THEN NULL ELSE functional_size / max_team_size END AS months_per_person
FROM form""")
def j08_month_split(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    return f.select("project_id", *J.month_split("functional_size", "max_team_size"))


J09_COLS = {"year": "year_of_project", "team": "max_team_size", "functional_size": "functional_size",
            "relative_size": "relative_size", "application_type": "application_type",
            "development_type": "development_type", "platform": "development_platform",
            "language_type": "language_type", "architecture": "architecture",
            "organisation": "organisation_type", "industry": "industry_sector", "language": "programming_language",
            "keep": "project_id"}


def _j09_sql():
    from tabloom.functions.domain import INDUSTRIES, LANGUAGES, TEXT_DEFAULTS
    team = "coalesce(max_team_size, 8)"
    cols = [
        "project_id", "coalesce(year_of_project, 2024) AS project_prf_year_of_project",
        f"{team} AS project_prf_max_team_size", "coalesce(functional_size, 100.0) AS project_prf_functional_size",
        f"round({EFFORT_SQL}, 6) AS project_prf_normalised_work_effort",
        f"CASE WHEN coalesce(industry_sector, 'Missing') IN ({', '.join(_lit(v) for v in INDUSTRIES)}) THEN industry_sector ELSE 'Missing' END AS external_eef_industry_sector",
        f"CASE WHEN coalesce(programming_language, 'Missing') IN ({', '.join(_lit(v) for v in LANGUAGES)}) THEN programming_language ELSE 'Missing' END AS tech_tf_primary_programming_language",
        f"CASE WHEN {team} <= 1 THEN '1' WHEN {team} <= 3 THEN '2-3' WHEN {team} <= 5 THEN '4-5' WHEN {team} <= 10 THEN '6-10' ELSE '11+' END AS project_prf_team_size_group",
    ]
    for name, src, rules in [("project_prf_application_group", "application_type", J.APP_GROUP),
                             ("project_prf_application_type_top", "application_type", J.APP_TYPE_TOP),
                             ("tech_tf_web_development", "application_type", J.WEB_DEV),
                             ("project_prf_development_type", "development_type", J.DEV_TYPE),
                             ("tech_tf_development_platform", "development_platform", J.PLATFORM),
                             ("tech_tf_language_type", "language_type", J.LANGUAGE_TYPE),
                             ("project_prf_relative_size", "relative_size", J.SIZE_CODE),
                             ("tech_tf_architecture", "architecture", J.ARCHITECTURE),
                             ("tech_tf_clientserver_description", "architecture", J.CLIENT_SERVER_DESC),
                             ("external_eef_organisation_type_top", "organisation_type", J.ORGANISATION)]:
        cols.append(f"{_rules_sql(src, rules, 'Missing')} AS {name}")
    cols += [f"{_lit(v)} AS {k}" for k, v in TEXT_DEFAULTS.items()]
    return with_sql(PROJECT_SQL, FORM_SQL) + f"\nSELECT {', '.join(cols)} FROM form"


@register("j09_training_features", _j09_sql(), headline=True)
def j09_training_features(spark, sf_dir):
    return rounded(J.training_features(form_frame(spark, sf_dir), J09_COLS))


@register("j10_missing_required", with_sql(PROJECT_SQL, FORM_SQL) + """
SELECT project_id, array_to_string(list_filter([CASE WHEN max_team_size IS NULL THEN 'max_team_size' END,
  CASE WHEN relative_size IS NULL OR relative_size = '' THEN 'relative_size' END,
  CASE WHEN application_type IS NULL OR application_type = '' THEN 'application_type' END], lambda x: x IS NOT NULL), ', ')
  AS missing_fields
FROM form""")
def j10_missing_required(spark, sf_dir):
    f = form_frame(spark, sf_dir)
    return J.missing_required(f, ["max_team_size", "relative_size", "application_type"]).select("project_id", "missing_fields")
