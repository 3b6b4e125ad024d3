"""The whole profile report of a table as one long table."""

from __future__ import annotations

from tabloom.operators import profile as P
from tabloom.plans.inputs import PROJECT_SQL, with_sql
from tabloom.plans.registry import register, rounded
from tabloom.plans.suite_profile import E03_NUM, E03_SQL, E03_TXT, analysis_frame, analysis_sql

TYPES = {"project_id": "bigint", "order_year": "int", "acct_balance": "double", "effort": "double", "is_odd": "bigint"}


def _sql() -> str:
    blank, none = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    parts = ["SELECT 'analysis' AS section, * FROM (" + analysis_sql() + ")"]
    for c in E03_NUM + E03_TXT:
        known = f"SELECT {c} AS v, CAST(count(*) AS DOUBLE) AS n FROM ana WHERE {c} IS NOT NULL GROUP BY 1"
        parts.append(f"SELECT 'summary', '{c}', 'data_type', {blank}, '{TYPES.get(c, 'string')}'")
        parts.append(f"SELECT 'summary', '{c}', 'samples', {blank}, array_to_string(list(CAST(v AS VARCHAR) ORDER BY v), ', ') "
                     f"FROM (SELECT v FROM ({known}) ORDER BY v LIMIT 5)")
        parts.append(f"SELECT 'top', '{c}', 'top_' || row_number() OVER (ORDER BY n DESC, v), n, CAST(v AS VARCHAR) "
                     f"FROM (SELECT * FROM ({known}) ORDER BY n DESC, v LIMIT 5)")
    for i, a in enumerate(E03_NUM):
        parts += [f"SELECT 'correlation', '{a}', '{b}', corr({a}, {b}), {none} FROM ana" for b in E03_NUM[i + 1:]]
    return (with_sql(PROJECT_SQL, E03_SQL) + "\nSELECT section, \"column\", metric, round(value, 4) AS value, detail FROM ("
            + "\nUNION ALL\n".join(parts) + ")")


@register("e20_profile", _sql())
def e20_profile(spark, sf_dir):
    return rounded(P.profile_report(analysis_frame(spark, sf_dir)), 4)
