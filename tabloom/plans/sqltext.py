"""SQL text of the column rules, for the DuckDB oracle strings.

Each helper returns SQL for the same rule the Spark expressions implement, so
oracle queries read like the Spark plan they check.
"""

from __future__ import annotations


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def clean_value(e: str) -> str:
    """C02: '-' -> '_', lower, strip."""
    return strip(f"lower(replace({e}, '-', '_'))")


def parts(e: str) -> str:
    """null -> [], split on ';', strip, drop empties."""
    return (rf"CASE WHEN {e} IS NULL THEN []::VARCHAR[] ELSE "
            rf"list_filter(regexp_split_to_array({strip(e)}, '\s*;\s*'), lambda x: x <> '') END")


def tidy(e: str) -> str:
    """C05 without mapping: lower, parts, dedupe, sort, join '; '."""
    return (f"CASE WHEN {e} IS NULL OR {e} = '' THEN {e} ELSE "
            f"array_to_string(list_sort(list_distinct({parts(f'lower({e})')})), '; ') END")


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def fixed_name(name: str) -> str:
    import re
    s = name.replace(" ", "_").replace("&", "and")
    s = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in s)
    return re.sub("_+", "_", s).strip("_")


def clean_category(e: str) -> str:
    """C04."""
    x = f"lower({strip(e)})"
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '[;,.]+$', '', 'g')"
    x = f"regexp_replace({x}, '[()]', '', 'g')"
    x = rf"regexp_replace({x}, ';\s*;', ';', 'g')"
    return rf"regexp_replace({x}, ';\s+', '; ', 'g')"


def standardize_token(e: str) -> str:
    """C07 (token rules, synonyms, web?, abbreviations)."""
    from tabloom.functions.text import TOKEN_ABBREVIATIONS, TOKEN_RULES, TOKEN_SYNONYMS
    x = strip(rf"regexp_replace({e}, '\s+', ' ', 'g')")
    for old, new in TOKEN_RULES:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    expanded = x
    for word, full in TOKEN_ABBREVIATIONS:
        expanded = rf"regexp_replace({expanded}, '\b{word}\b', '{full}', 'g')"
    syn = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in sorted(TOKEN_SYNONYMS.items()))
    return f"(CASE {syn} WHEN {strip(f'replace({x}, {chr(39)}?{chr(39)}, {chr(39)}{chr(39)})')} = 'web' THEN 'web' ELSE {expanded} END)"


def tidy_strict(e: str, standardize: bool = False) -> str:
    """C06 (optionally with C07 per part)."""
    p = f"list_filter({parts(f'lower({e})')}, lambda x: x <> 'nan')"
    p = rf"list_transform({p}, lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '[;,.]+$', '', 'g'))"
    if standardize:
        p = f"list_transform({p}, lambda y: {standardize_token('y')})"
    return f"CASE WHEN len({p}) > 0 THEN array_to_string(list_sort(list_distinct({p})), '; ') END"
