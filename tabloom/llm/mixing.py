"""Mixing sources to target weights: whole repeats plus one seeded draw a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, text_or_empty, utf8
from .prefix import in_order, prefix_sums

#: The white space between words: space and U+0009 to U+000D.
_SPACE = r"\x20\x09-\x0D"
_DRAW_BITS = 52


def word_count(col: str = "text") -> Column:
    """Number of runs of other characters than white space; null has none.

    Each run, with the white space around it, becomes one letter, so no list of a
    long text's words is ever held.
    """
    each = F.regexp_replace(text_or_empty(col), f"[{_SPACE}]*[^{_SPACE}]+[{_SPACE}]*", "x")
    return F.length(F.translate(each, " \t\n\x0b\x0c\r", "")).cast("long")


def draw(seed: str = "") -> Column:
    """A uniform number of 52 bits from seed, doc_id and text: the same in every run
    and on every executor, and another one for copies under other ids."""
    name = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(utf8()))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, _DRAW_BITS // 4), 16, 10).cast("long")


def source_rates(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) of a table of (source, size).

    Sources, in code-point order with null last, weigh ``weights``, repeated over
    and over. Together they are to get ``share`` times all sizes, by weight, but
    none above ``cap`` times its own size; what is above is shared out again. That
    ends at one level t with target = min(weight * t, cap * size): with sources
    sorted by cap * size / weight, t is the largest of (all - caps so far) /
    (weights from here on), so two prefix sums and a maximum give it for any number
    of sources. Rates are target / size, 0 for a source without words. Sizes are
    added up before the shuffle, so a hot source costs no more than others. If all
    sources are at their caps (share >= cap), so be it. No rows, no sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    placed = prefix_sums(in_order(sums, by_name), {"place": F.lit(1)}, [by_name])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = placed.select("source", "source_size", turn.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    by_level = [(F.col("most") / F.col("weight")).asc(), by_name]
    filled = prefix_sums(in_order(weighed, *by_level), {"full": F.col("most"), "used": F.col("weight")}, by_level)
    whole = weighed.agg((F.lit(float(share)) * F.sum("source_size")).alias("all"), F.sum("weight").alias("weights"))
    level = (filled.crossJoin(F.broadcast(whole))                       # one row: the totals
             .agg(F.max((F.col("all") - F.col("full")) / (F.col("weights") - F.col("used"))).alias("level")))
    target = F.least(F.col("weight") * F.col("level"), F.col("most"))
    return (weighed.crossJoin(F.broadcast(level))                       # one row again
            .select("source", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")))


def _copies(rate: Column, number: Column) -> Column:
    """floor(rate), and one more where the draw is below the fraction."""
    fraction = (rate - F.floor(rate)) * F.lit(float(1 << _DRAW_BITS))
    return (F.floor(rate) + (number < fraction).cast("long")).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Join by source, null included. Which side is broadcast, if any, is left to
    Spark, which knows their sizes; a hot source's rows are dealt to several tasks."""
    return rows.join(rates.withColumnRenamed("source", "source_of_rate"),
                     F.col("source").eqNullSafe(F.col("source_of_rate")), "left").drop("source_of_rate")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes
    each row of ``docs``, 0 times included.

    A document's size is its number of words; ``copies`` is floor(rate) and one more
    with a probability of the rate's fraction, by a draw seeded with doc_id and
    text, so reruns agree and copies never exceed ``cap`` rounded up. Null and empty
    texts have size 0 and are drawn like others; a null source is a source; a row
    that is repeated exactly shares its draw; further columns are ignored. An empty
    table gives an empty result. Texts are read once.
    """
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             word_count().alias("size"), draw(seed).alias("draw")))
    joined = _with_rates(rows, source_rates(rows, weights, share, cap))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("rate"), F.col("draw")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "") -> DataFrame:
    """The mixed documents: every row of ``docs`` as many times as ``mixture`` says,
    with all its columns (helper names give way to them). Same results for odd rows."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), word_count().alias("size"))
    rates = stage(source_rates(stage(sizes.groupBy("source").agg(F.sum("size").alias("size"))), weights, share, cap))
    name, rate = free_name(docs.columns, "source_of_rate"), free_name(docs.columns, "mix_rate")
    rates = rates.select(F.col("source").alias(name), F.col("rate").alias(rate))
    joined = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col(name)), "left")
    return (joined.withColumn(rate, F.explode(F.array_repeat(F.lit(1), _copies(F.col(rate), draw(seed)).cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
