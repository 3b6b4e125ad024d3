"""Domain feature rules as column expressions.

The rules are data: ordered lists of ``(any_of, none_of, value)`` keyword rules
tested with case-insensitive ``contains`` on the upper-cased input, first hit
wins (an ordered ``CASE WHEN``; the order is the spec, T9). Nothing here runs
Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Sequence[str], Sequence[str], object]

# ---------------------------------------------------------------------------
# Fixed values (the reference's effort heuristics and category rules)
# ---------------------------------------------------------------------------
TEAM_EDGES = [1, 3, 5, 10]
TEAM_LABELS = ["1", "2-3", "4-5", "6-10", "11+"]

SIZE_FACTOR: list[Rule] = [
    (["XS", "EXTRA SMALL"], [], 0.5),
    (["SMALL"], ["XS"], 0.8),
    (["LARGE"], ["XL"], 1.5),
    (["XL", "EXTRA LARGE"], [], 2.0),
]
APP_FACTOR: list[Rule] = [(["WEB"], [], 1.2), (["MOBILE"], [], 1.0), (["DESKTOP"], [], 1.3), (["API"], [], 0.8)]
DEV_FACTOR: list[Rule] = [(["NEW"], [], 1.0), (["ENHANCEMENT"], [], 0.7), (["MAINTENANCE"], [], 0.5)]
BASE_HOURS_PER_PERSON = 200
EFFORT_SCALE = 1000
DEFAULT_TEAM = 5

APP_GROUP: list[Rule] = [(["WEB", "BUSINESS"], [], "business_application")]
APP_TYPE_TOP: list[Rule] = [(["WEB", "BUSINESS"], [], "business application"),
                            (["FINANCIAL"], [], "financial transaction process/accounting")]
WEB_DEV: list[Rule] = [(["WEB", "BUSINESS"], [], "web")]
DEV_TYPE: list[Rule] = [(["NEW"], [], "new_development"), (["ENHANCEMENT"], [], "enhancement")]
PLATFORM: list[Rule] = [(["CLOUD", "PC"], [], "pc"), (["MULTI"], [], "multi")]
LANGUAGE_TYPE: list[Rule] = [(["OBJECT", "3GL"], [], "3gl"), (["4GL"], [], "4gl")]
SIZE_CODE: list[Rule] = [
    (["MEDIUM"], [], "m1"),
    (["M"], ["SMALL"], "m1"),
    (["LARGE"], ["XL"], "l"),
    (["SMALL"], ["XS"], "s"),
    (["XL", "EXTRA LARGE"], [], "xl"),
    (["XS", "EXTRA SMALL"], [], "xs"),
]
ARCHITECTURE: list[Rule] = [(["MULTI", "MICRO"], [], "multi_tier"), (["CLIENT"], [], "client_server")]
CLIENT_SERVER_DESC: list[Rule] = [(["MULTI", "MICRO"], [], "web"), (["CLIENT"], [], "client_server")]
ORGANISATION: list[Rule] = [(["LARGE", "ENTERPRISE"], [], "computers & software"), (["BANKING"], [], "banking"),
                            (["GOVERNMENT"], [], "government")]
INDUSTRIES = ["Technology", "Banking", "Healthcare", "Manufacturing", "Government"]
LANGUAGES = ["Python", "Java", "JavaScript", "C#", "PHP", "Ruby", "C++", "C"]
TEXT_DEFAULTS = {
    "external_eef_data_quality_rating": "A",
    "process_pmf_development_methodologies": "Missing",
    "tech_tf_client_roles": "Missing",
    "tech_tf_server_roles": "Missing",
    "process_pmf_docs": "Missing",
    "tech_tf_tools_used": "Missing",
    "project_prf_case_tool_used": "Missing",
    "process_pmf_prototyping_used": "Missing",
    "tech_tf_client_server": "Missing",
    "tech_tf_type_of_server": "Missing",
    "tech_tf_dbms_used": "Missing",
    "people_prf_project_user_involvement": "Missing",
    "project_prf_currency_multiple": "Missing",
}
NUMERIC_DEFAULTS = {"year_of_project": 2024, "max_team_size": 8, "functional_size": 100}
# Flag groups (H05): part of the group's name, input column, [(any of, none of, flag words)], default
# flag words; words are tried in order. Other groups take the first flag with a word of FLAG_DEFAULTS.
GROUP_RULES = [
    ("application_group", "project_prf_application_type", [(["WEB", "BUSINESS"], [], ["business_application"])], ["nan", "missing"]),
    ("clientserver_description", "tech_tf_architecture",
     [(["MICRO", "WEB"], [], ["web"]), (["CLIENT"], [], ["client_server"])], ["nan", "missing"]),
    ("development_type", "project_prf_development_type",
     [(["NEW"], [], ["new_development"]), (["ENHANCEMENT"], [], ["enhancement"])], ["other", "nan"]),
    ("development_platform", "tech_tf_development_platform", [(["CLOUD", "PC"], [], ["pc"]), (["MULTI"], [], ["multi"])], ["nan"]),
    ("language_type", "tech_tf_language_type", [(["OBJECT", "3GL"], [], ["3gl"]), (["4GL"], [], ["4gl"])], ["nan"]),
    ("relative_size", "project_prf_relative_size",
     [(["MEDIUM"], [], ["m1", "m2"]), (["LARGE"], ["XL"], ["l"]), (["SMALL"], ["XS"], ["s"]), (["XL"], [], ["xl"]), (["XS"], [], ["xs"])],
     ["nan"]),
    ("architecture", "tech_tf_architecture",
     [(["MICRO", "MULTI"], [], ["multi_tier"]), (["CLIENT"], [], ["client_server"])], ["nan", "stand_alone"]),
    ("data_quality_rating", None, [], ["a"]),
    ("organisation_type", "external_eef_organisation_type",
     [(["LARGE", "ENTERPRISE"], [], ["computers", "software"]), (["BANKING"], [], ["banking"]), (["GOVERNMENT"], [], ["government"])],
     ["nan", "other"]),
]
FLAG_DEFAULTS = ["nan", "no", "missing", "other"]
HOURS_PER_DAY, DAYS_PER_WEEK, WEEKS_PER_MONTH = 8, 5, 4.33
LOW_WARNING, HIGH_WARNING = 10, 5000
# Row-check messages (J05) and their limits.
MSG_TEAM_NOT_POSITIVE = "Team size must be positive"
MSG_TARGET_NOT_POSITIVE = "Target value is zero or negative"
MSG_TARGET_HIGH = "Target value seems very high (>10)"
MSG_TEAM_LARGE = "Very large team size (>50)"
TARGET_HIGH, TEAM_LARGE = 10, 50


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# J01 -----------------------------------------------------------------------
def bucketize(col: Column | str, edges: Sequence[float] = TEAM_EDGES, labels: Sequence[str] = TEAM_LABELS) -> Column:
    """Right-closed buckets: x <= edges[0] -> labels[0] ... else labels[-1]."""
    x = _c(col)
    out = F.when(x <= edges[0], F.lit(labels[0]))
    for e, lab in zip(edges[1:], labels[1:]):
        out = out.when(x <= e, F.lit(lab))
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(labels[-1])))


# J02 / J03 -------------------------------------------------------------------
def keyword_code(col: Column | str, rules: Sequence[Rule], default=None) -> Column:
    """First rule whose any-of keyword is contained (and none-of keywords are
    not) in the upper-cased input; null input is tested as ''."""
    s = F.upper(F.coalesce(_c(col).cast("string"), F.lit("")))
    out = None
    for any_of, none_of, value in rules:
        cond = None
        for k in any_of:
            c = F.contains(s, F.lit(k))
            cond = c if cond is None else (cond | c)
        for k in none_of:
            cond = cond & ~F.contains(s, F.lit(k))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def keyword_codes(col: Column | str, outputs: Mapping[str, tuple[Sequence[Rule], object]]) -> list[Column]:
    return [keyword_code(col, rules, default).alias(name) for name, (rules, default) in outputs.items()]


# J04 -----------------------------------------------------------------------
def estimate_effort(team: Column | str, size: Column | str, app: Column | str, dev: Column | str) -> Column:
    """200 * team * size factor * application factor * development factor / 1000."""
    t = F.coalesce(_c(team).cast("double"), F.lit(float(DEFAULT_TEAM)))
    f = (keyword_code(size, SIZE_FACTOR, 1.0) * keyword_code(app, APP_FACTOR, 1.0) * keyword_code(dev, DEV_FACTOR, 1.0))
    return F.lit(float(BASE_HOURS_PER_PERSON)) * t * f / F.lit(float(EFFORT_SCALE))


# J05 -----------------------------------------------------------------------
def validate_row_rules(df: DataFrame, required_numeric: Sequence[str], team: str, target: str) -> DataFrame:
    """Adds ``valid``, ``errors`` and ``warnings`` (joined messages) per row."""
    errs = []
    for c in required_numeric:
        errs.append(F.when(F.col(c).isNull(), F.lit(f"missing: {c}")))
    errs.append(F.when(F.col(team) <= 0, F.lit(MSG_TEAM_NOT_POSITIVE)))
    warns = [F.when(F.col(target) <= 0, F.lit(MSG_TARGET_NOT_POSITIVE))
             .when(F.col(target) > TARGET_HIGH, F.lit(MSG_TARGET_HIGH)),
             F.when(F.col(team) > TEAM_LARGE, F.lit(MSG_TEAM_LARGE))]
    e = F.filter(F.array(*errs), lambda x: x.isNotNull())
    w = F.filter(F.array(*warns), lambda x: x.isNotNull())
    return df.select("*", (F.size(e) == 0).alias("valid"), F.array_join(e, "; ").alias("errors"),
                     F.array_join(w, "; ").alias("warnings"))


# J06 -----------------------------------------------------------------------
def feature_counts(df: DataFrame, cols: Sequence[str] | None = None, missing_word: str = "Missing") -> DataFrame:
    """Per row: numeric, categorical and missing value counts over ``cols``."""
    from pyspark.sql.types import NumericType
    cols = list(cols or df.columns)
    num = [c for c in cols if isinstance(df.schema[c].dataType, NumericType)]
    cat = [c for c in cols if c not in num]
    miss = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == missing_word), 1).otherwise(0) for c in cols]
    return df.select("*", F.lit(len(cols)).alias("total_features"), F.lit(len(num)).alias("numeric_features"),
                     F.lit(len(cat)).alias("categorical_features"),
                     sum(miss[1:], miss[0]).alias("missing_values"))


# J07 / J08 -------------------------------------------------------------------
def effort_units(hours: Column | str, team: Column | str) -> list[Column]:
    h, t = _c(hours), _c(team)
    days = h / HOURS_PER_DAY
    weeks = days / DAYS_PER_WEEK
    return [days.alias("days"), weeks.alias("weeks"), (weeks / WEEKS_PER_MONTH).alias("months"),
            F.when(t > 0, h / t).otherwise(h).alias("per_person"),
            F.when(h < LOW_WARNING, "low").when(h > HIGH_WARNING, "high").alias("warning")]


def month_split(months: Column | str, team: Column | str) -> list[Column]:
    m, t = _c(months), _c(team)
    whole = F.floor(m).cast("int")
    return [whole.alias("whole_months"), F.floor((m - whole) * 30).cast("int").alias("remaining_days"),
            F.try_divide(m, t).alias("months_per_person")]


# J09 -----------------------------------------------------------------------
def training_features(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Training-compatible row (C11 + C12 + J01-J04) in ONE select.

    ``cols`` names the raw inputs: year, team, size, functional_size,
    relative_size, application_type, development_type, platform,
    language_type, architecture, organisation, industry, language."""
    from tabloom.functions.text import whitelist
    g = {k: F.col(v) for k, v in cols.items()}
    team = F.coalesce(g["team"], F.lit(NUMERIC_DEFAULTS["max_team_size"]))
    out = [
        F.coalesce(g["year"], F.lit(NUMERIC_DEFAULTS["year_of_project"])).alias("project_prf_year_of_project"),
        team.alias("project_prf_max_team_size"),
        F.coalesce(g["functional_size"], F.lit(float(NUMERIC_DEFAULTS["functional_size"]))).alias("project_prf_functional_size"),
        estimate_effort(g["team"], g["relative_size"], g["application_type"], g["development_type"])
        .alias("project_prf_normalised_work_effort"),
        whitelist(F.coalesce(g["industry"], F.lit("Missing")), INDUSTRIES).alias("external_eef_industry_sector"),
        whitelist(F.coalesce(g["language"], F.lit("Missing")), LANGUAGES).alias("tech_tf_primary_programming_language"),
        bucketize(team).alias("project_prf_team_size_group"),
        keyword_code(g["application_type"], APP_GROUP, "Missing").alias("project_prf_application_group"),
        keyword_code(g["application_type"], APP_TYPE_TOP, "Missing").alias("project_prf_application_type_top"),
        keyword_code(g["application_type"], WEB_DEV, "Missing").alias("tech_tf_web_development"),
        keyword_code(g["development_type"], DEV_TYPE, "Missing").alias("project_prf_development_type"),
        keyword_code(g["platform"], PLATFORM, "Missing").alias("tech_tf_development_platform"),
        keyword_code(g["language_type"], LANGUAGE_TYPE, "Missing").alias("tech_tf_language_type"),
        keyword_code(g["relative_size"], SIZE_CODE, "Missing").alias("project_prf_relative_size"),
        keyword_code(g["architecture"], ARCHITECTURE, "Missing").alias("tech_tf_architecture"),
        keyword_code(g["architecture"], CLIENT_SERVER_DESC, "Missing").alias("tech_tf_clientserver_description"),
        keyword_code(g["organisation"], ORGANISATION, "Missing").alias("external_eef_organisation_type_top"),
    ]
    out += [F.lit(v).alias(k) for k, v in TEXT_DEFAULTS.items()]
    return df.select(*[F.col(k) for k in cols.get("keep", "").split(",") if k], *out)


# J10 -----------------------------------------------------------------------
def missing_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    miss = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c))
                              for c in required]), lambda x: x.isNotNull())
    return df.select("*", F.array_join(miss, ", ").alias("missing_fields"))
