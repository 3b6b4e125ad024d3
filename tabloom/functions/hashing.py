"""Deterministic, engine-portable row hashing.

Sampling, folds, splits and permutations order rows by a 32-bit integer mix of
a key and a seed. It is built only from shifts, xor, and-masks and a multiply
that cannot overflow a signed 64-bit integer, so the same value can be computed
by Spark (in codegen, no UDF) and by any SQL engine with bit operators (the
DuckDB oracle uses ``mix32_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

MASK32 = 0xFFFFFFFF
MUL = 0x45D9F3B          # odd 27-bit multiplier of the classic 32-bit integer mix
GOLDEN = 0x9E3779B9      # seed spreader


def _seed_bits(seed: int) -> int:
    return (seed * GOLDEN) & MASK32


def text_key(key: Column) -> Column:
    """A long made from the text of any value, the same in every engine with md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def text_key_sql(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 15) AS BIGINT)"


def row_key(df: DataFrame, key: str) -> Column:
    """The key column as a long: whole numbers as they are, other types by their text."""
    c = F.col("`" + key.replace("`", "``") + "`")
    return c.cast("long") if isinstance(df.schema[key].dataType, IntegralType) else text_key(c)


def mix32(key: Column | str, seed: int = 0) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    k = k.cast("long")
    x = k.bitwiseXOR(F.shiftright(k, 32)).bitwiseAND(F.lit(MASK32))
    x = x.bitwiseXOR(F.lit(_seed_bits(seed)))
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)).__mul__(F.lit(MUL)).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix32_sql(expr: str, seed: int = 0) -> str:
    """The same function as SQL text (DuckDB: ``xor``, ``>>``, ``&``)."""
    k = f"CAST({expr} AS BIGINT)"
    x = f"(xor({k}, {k} >> 32) & {MASK32})"
    x = f"xor({x}, {_seed_bits(seed)})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {MUL}) & {MASK32})"
    return f"xor({x}, {x} >> 16)"


def unit_uniform(key: Column | str, seed: int = 0) -> Column:
    """(0, 1) uniform from the hash; never exactly 0 or 1."""
    return (mix32(key, seed).cast("double") + F.lit(0.5)) / F.lit(float(MASK32 + 1))
