"""Text and category cleaning as Spark column expressions.

Everything here returns a ``Column`` built from JVM-side functions
(``regexp_replace``, ``split``, ``array_*``), so it stays inside whole-stage
codegen; no Python UDF runs per row. Frame-level helpers apply one expression
to many columns in a single ``select``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour)
# ---------------------------------------------------------------------------
# Ordered token rules of the strict standardiser (C07), applied as plain
# substring replacements in this order.
TOKEN_RULES = [
    (" ;", ";"),
    ("; ", ";"),
    (" & ", "_"),
    ("&/or", "_"),
    (" &", "_"),
    ("/", "_"),
    (": ", "_"),
    (" (", "_"),
    ("(", ""),
    (")", ""),
    (" + ", "_"),
]
# Whole-value synonyms of C07, checked after the token rules.
TOKEN_SYNONYMS = {
    "stand alone": "stand-alone",
    "stand-alone": "stand-alone",
    "client server": "client-server",
    "mathematically intensive": "mathematically-intensive",
    "mathematically intensive application": "mathematically-intensive application",
}
# Word abbreviations expanded by C07.
TOKEN_ABBREVIATIONS = [
    ("psp", "personal_software_process"),
    ("jad", "joint_application_development"),
]
# Residual format rules of C15: (rule name, Java regex that flags the value).
FORMAT_RULES = [
    ("amp_spaced", r" & "),
    ("amp_or", r"&/or"),
    ("amp_left", r" &"),
    ("slash", r"/"),
    ("colon_space", r": "),
    ("parentheses", r"[()]"),
    ("plus_spaced", r" \+ "),
    ("double_space", r"  "),
    ("edge_space", r"^ | $"),
    ("uppercase", r"[A-Z]"),
    ("double_underscore", r"__"),
]

WS_EDGES = r"^\s+|\s+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


WS_CHARS = " \t\n\r\f\x0b"   # the characters of Java's \s


def strip_ws(col: Column | str) -> Column:
    """Strip all leading/trailing whitespace (Spark ``trim`` only removes
    spaces): ``btrim`` with the whitespace set, no regex per value."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def apply_to(df: DataFrame, cols: Iterable[str], fn) -> DataFrame:
    """One ``select`` that rewrites ``cols`` with ``fn`` and keeps column order."""
    cols = set(cols)
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def map_lookup(col: Column, mapping: Mapping[str, str]) -> Column:
    """``mapping.get(x, x)`` as a map-literal lookup (small config maps)."""
    if not mapping:
        return col
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(F.try_element_at(m, col), col)


# C01 -----------------------------------------------------------------------
def normalize_text(df: DataFrame, null_token: str | None = None) -> DataFrame:
    """Lower + strip every text column. ``null_token='nan'`` reproduces the
    legacy cast of nulls to text (T1)."""
    def fn(c):
        out = strip_ws(F.lower(c))
        return F.coalesce(out, F.lit(null_token)) if null_token is not None else out
    return apply_to(df, text_columns(df), fn)


# C02 -----------------------------------------------------------------------
def clean_value(col: Column | str) -> Column:
    return strip_ws(F.lower(F.replace(_c(col), F.lit("-"), F.lit("_"))))


def clean_values(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return apply_to(df, text_columns(df) if cols is None else cols, clean_value)


# C03 is a fitted operator: tabloom.operators.encode.ValueStandardizer

# C04 -----------------------------------------------------------------------
def clean_category(col: Column | str) -> Column:
    x = F.lower(strip_ws(_c(col)))
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"[;,.]+$", "")
    x = F.regexp_replace(x, r"[()]", "")
    x = F.regexp_replace(x, r";\s*;", ";")
    return F.regexp_replace(x, r";\s+", "; ")


# C05 / C06 -------------------------------------------------------------------
def split_parts(col: Column | str, sep: str = ";") -> Column:
    """null -> empty list, split, strip, drop empties (array<string>)."""
    c = _c(col)
    parts = F.split(strip_ws(c), rf"\s*{re.escape(sep)}\s*")
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array_remove(parts, ""))


def tidy_multivalue(col: Column | str, mapping: Mapping[str, str] | None = None,
                    strict: bool = False, standardize: bool = False, sep: str = "; ", lowered: bool = False) -> Column:
    """Split on ';', strip, lower, drop empties, map, dedupe, sort, join '; '.

    ``strict`` (C06): also drops ``nan`` parts, collapses inner whitespace,
    trims trailing ``;,.``, and turns ``''``/``'nan'``/no parts into null.
    ``standardize`` applies the C07 token rules to each part (strict only).
    ``lowered``: the column holds no upper case.
    """
    c = _c(col)
    parts = split_parts(c if lowered else F.lower(c))
    if strict:
        parts = F.array_remove(parts, "nan")
        parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"[;,.]+$", ""))
        if standardize:
            parts = F.transform(parts, lambda p: standardize_token(p))
    if mapping:
        parts = F.transform(parts, lambda p: map_lookup(p, mapping))
    joined = F.array_join(F.array_sort(F.array_distinct(parts)), sep)
    if strict:
        return F.when(F.size(parts) > 0, joined)
    return F.when(c.isNull() | (c == ""), c).otherwise(joined)


# C07 / C08 -------------------------------------------------------------------
def standardize_token(col: Column | str, synonyms: Mapping[str, str] | None = None) -> Column:
    syn = TOKEN_SYNONYMS if synonyms is None else synonyms
    x = strip_ws(F.regexp_replace(_c(col), r"\s+", " "))
    for old, new in TOKEN_RULES:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")
    expanded = x
    for word, full in TOKEN_ABBREVIATIONS:
        expanded = F.regexp_replace(expanded, rf"\b{word}\b", full)
    syn_map = F.create_map(*[F.lit(v) for kv in sorted(syn.items()) for v in kv]) if syn else None
    out = F.when(strip_ws(F.replace(x, F.lit("?"), F.lit(""))) == "web", F.lit("web")).otherwise(expanded)
    if syn_map is not None:
        out = F.coalesce(F.try_element_at(syn_map, x), out)
    return out


def standardize_single(col: Column | str) -> Column:
    x = F.lower(strip_ws(_c(col)))
    return F.when((x == "") | (x == "nan"), F.lit(None).cast("string")).otherwise(standardize_token(x))


# C09 -----------------------------------------------------------------------
def upper_code(col: Column | str) -> Column:
    return F.nullif(strip_ws(F.upper(_c(col).cast("string"))), F.lit("NAN"))


# C11 -----------------------------------------------------------------------
def whitelist(col: Column | str, allowed: Iterable[str], default: str = "Missing") -> Column:
    c = _c(col)
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


# C12 -----------------------------------------------------------------------
def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill absent inputs: null -> default; a missing column is added."""
    out = []
    for c in df.columns:
        out.append(F.coalesce(F.col(f"`{c}`"), F.lit(defaults[c])).alias(c) if c in defaults else F.col(f"`{c}`"))
    out += [F.lit(v).alias(k) for k, v in defaults.items() if k not in df.columns]
    return df.select(*out)


# C17 -----------------------------------------------------------------------
def pretty_name(col: Column | str) -> Column:
    """``top_model_3_GradientBoost`` -> ``Gradient Boost`` (drop prefix, split camel case)."""
    x = F.regexp_replace(_c(col), r"\.[^.]*$", "")
    x = F.regexp_replace(x, r"^top_model_\d+_", "")
    return strip_ws(F.regexp_replace(x, r"(?<!^)(?=[A-Z])", " "))


def title_words(col: Column | str) -> Column:
    """``gradient_boost`` -> ``Gradient Boost`` (split on '_' and capitalise words)."""
    words = F.split(_c(col), "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                             F.lower(F.substring(w, 2, 1 << 20)))), " ")
