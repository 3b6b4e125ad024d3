"""Benchmark decontamination by typed templates, hash joins and slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashSet64, Memo, free_name, stage, utf8

#: Words that are a unit wherever they stand, and those that are one after a number.
MEASURES = frozenset("""km cm mm kg mg ml lbs mph kmh hz khz mhz ghz kb mb gb tb kw mw usd eur gbp mile miles inch inches
feet foot yard yards meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms
pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons second seconds minute minutes
hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents""".split())
UNITS = frozenset("m in ft yd mi g lb oz t l s sec secs min mins h hr hrs w v a k c f".split())

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_NUMBER, _END, _TITLE, _UNIT, _WORD, _MEASURE = 1, 2, 3, 4, 5, 6
_KIND_BITS = 3
_LITERAL = 2                  # the way of windows that are looked for as they stand; 0, 1: templates with, without names
_PLACE = {_NUMBER: "<number>", _TITLE: "<name>", _UNIT: "<unit>"}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(word.encode()) >> _KIND_BITS << _KIND_BITS


class _Codes(Memo):
    """token -> hash of its lower-cased form, with its kind in the low bits."""

    def __missing__(self, token: str) -> int:
        if token[0].isdigit():
            code = _hash("0") | _NUMBER
        elif token in ".!?\n":
            code = _END
        else:
            low = token.lower()
            title = token[0].isupper() and token[1:] == low[1:] and len(token) > 1
            code = _hash(low) | (_MEASURE if low in MEASURES else _TITLE if title else _UNIT if low in UNITS else _WORD)
        self.make_room(1)
        self[token] = code
        return code


_codes = _Codes(500_000)
_HOLDER = {kind: np.uint64(_hash(name) | kind) for kind, name in _PLACE.items()}


def template(text: str, names: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, codes, typed) of a text: see ``_template``, without the places of marks."""
    return _template(text, names)[:3]


def _template(text: str, names: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, typed, cuts) of a text: numbers, names and units become placeholders.

    A number is a run of digits (with . or , inside); a unit is a listed word, the
    short ones only right after a number; a name is a word with only its first letter a capital that
    does not begin a sentence or line (with ``names`` false: none is). Other words
    count in lower case; marks don't count. ``typed`` tells a word's placeholder;
    ``cuts`` are the numbers of words that stand before each end of a sentence or line,
    the text's own begin and end among them.
    """
    tokens = _TOKEN.findall(text)
    if not tokens:
        return [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    codes = np.fromiter(map(_codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    kind = (codes & np.uint64(7)).astype(np.int64)
    word = kind != _END
    cuts = np.unique(np.concatenate(([0], np.cumsum(word)[~word], [word.sum()])))
    before = np.concatenate(([_END], kind[:-1]))[word]
    kind, codes = kind[word], codes[word] & ~np.uint64(7)
    kind[(kind == _TITLE) & ((before == _END) | (not names))] = _WORD
    kind[(kind == _UNIT) & (before != _NUMBER)] = _WORD
    kind[kind == _MEASURE] = _UNIT
    for k, holder in _HOLDER.items():
        codes[kind == k] = holder
    return [t for t, w in zip(tokens, word.tolist()) if w], codes, kind, cuts


def literal(words: list[str], kind: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The codes of a text's words as they stand, lower-cased, without placeholders."""
    codes = codes.copy()
    for i in np.flatnonzero(kind != _WORD).tolist():
        codes[i] = _hash(words[i].lower())
    return codes


def unnamed(words: list[str], codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, typed) of a template when no word is a name."""
    codes = codes.copy()
    for i in np.flatnonzero(kind == _TITLE).tolist():
        codes[i] = _codes[words[i]] & ~7
    return codes, np.where(kind == _TITLE, _WORD, kind)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = (h ^ (h >> np.uint64(29))) * _FACTOR + codes[j:j + n]
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def _slots(words: list[str], kind: np.ndarray, at: int, size: int) -> list[str]:
    return [f"{k} {words[i].lower()}" for i in range(at, at + size) if (k := int(kind[i])) in _PLACE]


def _literals(kind: np.ndarray, size: int) -> np.ndarray:
    """Whether at least half of a window's words are no placeholders."""
    plain = np.concatenate(([0], np.cumsum(kind == _WORD)))
    return 2 * (plain[size:] - plain[:-size]) >= size


def _whole_lines(h: np.ndarray, size: int, cuts: np.ndarray) -> np.ndarray:
    """Those of the windows that begin and end where a sentence, line or text does."""
    return h[np.intersect1d(cuts, cuts - size)] if len(h) else h


def _item_windows(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, x in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                text = x.as_py().decode()
                for way, names in enumerate((True, False)):            # a copy all in capitals shows no names
                    words, codes, kind = template(text, names)
                    if not words:
                        continue
                    w = min(size, len(words))
                    good = _literals(kind, w) & (len(words) >= least)
                    rows += [(int(h), w, item, i, way, int(good.sum()), len(good), _slots(words, kind, i, w))
                             for i, h in enumerate(windows(codes, w).view(np.int64)) if good[i]]
                    if names:
                        rows += [(int(h), -w, item, i, _LITERAL, 0, len(good), [])
                                 for i, h in enumerate(windows(literal(words, kind, codes), w).view(np.int64)) if not good[i]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=["hash", "size", "item_id", "item_pos", "way", "way_windows", "item_windows", "item_slots"])
    return run


def _doc_windows(sizes: list[int], maybe, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, codes, kind, cuts = _template(x.as_py().decode())
                named = np.concatenate(([0], np.cumsum(kind == _TITLE)))
                plain_codes, plain = unnamed(words, codes, kind)        # Title Case, and first words after a colon
                for size in sizes:
                    if size < 0:                                        # once a document is enough
                        h = windows(literal(words, kind, codes), -size)
                        h = np.unique(_whole_lines(h, -size, cuts) if -size < least else h)
                        rows += [(h, size, doc, 0, []) for h in h[maybe.value.maybe(h)].view(np.int64).tolist()]
                        continue
                    h = windows(codes, size)
                    rows += [(int(h[i].view(np.int64)), size, doc, i, _slots(words, kind, i, size))
                             for i in np.flatnonzero(maybe.value.maybe(h)).tolist()]
                    if named[-1] and len(h):
                        h = windows(plain_codes, size)
                        rows += [(int(h[i].view(np.int64)), size, doc, i, _slots(words, plain, i, size))
                                 for i in np.flatnonzero(maybe.value.maybe(h) & (named[size:] > named[:-size])).tolist()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=["hash", "size", "doc_id", "doc_pos", "doc_slots"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5, least: int = 5) -> DataFrame:
    """(doc_id, item_id, matched, of): documents that hold a benchmark item, also with
    other numbers, names or units.

    Both sides become typed templates (``template``), with names and without, so that
    first words and Title Case match too; windows of ``size`` words (of
    the whole item, if it is shorter) are hash-joined. Matches of a document and an
    item that lie on one alignment must fill their slots consistently: each value of
    the item stands for one value of the document; windows that hold a value for
    which this fails are dropped. Windows with more placeholders than words, and
    items of fewer than ``least`` words, can't be told from chance as templates: their
    words are looked for as they stand, in any case, numbers included; an item of
    fewer than ``least`` words must also fill whole sentences or lines.

    An item is held if at least ``share`` of all its windows match, or of those that
    are looked for as templates (with names, or without) if these are at least
    ``share`` of all; ``matched`` of ``of`` is the larger of these shares.

    Null and empty texts and items match nothing; null ids never match; repeated
    documents give one row each pair of ids; further columns are ignored; empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).where("item_id is not null")
                  .mapInArrow(_item_windows(size, least), "hash long, size int, item_id long, item_pos int, way int, way_windows int, "
                              "item_windows int, item_slots array<string>").distinct())
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())      # at most 2 * size of them
    maybe = spark.sparkContext.broadcast(HashSet64.of(items, "hash"))
    hits = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).where("doc_id is not null")
            .mapInArrow(_doc_windows(sizes, maybe, least), "hash long, size int, doc_id long, doc_pos int, doc_slots array<string>"))
    found = ["doc_id", "item_id", "item_pos", "way", "way_windows", "item_windows"]
    pairs = stage(hits.join(items, ["hash", "size"]).where(F.size("doc_slots") == F.size("item_slots"))
                  .select(*found, "doc_slots", "item_slots", (F.col("doc_pos") - F.col("item_pos")).alias("shift")))
    line = ["doc_id", "item_id", "shift"]
    filled = (pairs.where(F.size("item_slots") > 0)
              .select(*line, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s"))
              .select(*line, F.col("s.item_slots").alias("theirs"), F.col("s.doc_slots").alias("ours")).distinct())
    torn = (filled.groupBy(*line, "theirs").agg(F.count("*").alias("n")).where("n > 1")
            .groupBy(*line).agg(F.collect_set("theirs").alias("torn")))
    whole = (pairs.join(torn, line, "left")
             .where(F.col("torn").isNull() | ~F.arrays_overlap("item_slots", "torn")).select(*found))
    by_way = [f"max(case when way = {w} then {v} else 0 end) as {c}{w}" for w in (0, 1) for v, c in ((1, "hit"), ("way_windows", "of"))]
    enough = {of: F.col(of) >= F.col("item_windows") * F.lit(share) for of in ("item_windows", "of0", "of1")}
    shares = [F.struct(F.when(enough[of], F.col(m) / F.greatest(F.col(of), F.lit(1))).alias("part"), F.col(of).alias("of"), F.col(m).alias("matched"))
              for m, of in (("matched", "item_windows"), ("matched0", "of0"), ("matched1", "of1"))]
    return (whole.groupBy("doc_id", "item_id", "item_pos").agg(F.max("item_windows").alias("item_windows"), *map(F.expr, by_way))
            .groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"), F.max("item_windows").alias("item_windows"),
                                              F.sum("hit0").alias("matched0"), F.max("of0").alias("of0"), F.sum("hit1").alias("matched1"), F.max("of1").alias("of1"))
            .select("doc_id", "item_id", F.array_max(F.array(*shares)).alias("best"))
            .select("doc_id", "item_id", F.col("best.matched").cast("int").alias("matched"), F.col("best.of").alias("of"))
            .where(F.col("matched") >= F.col("of") * F.lit(share)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are. Rows with
    null ids or texts stay, repeated rows stay or go together, and an empty table of
    either kind drops nothing."""
    name = free_name(docs.columns, "contaminated_id")
    bad = stage(contaminated(docs, benchmark, **how).select("doc_id").distinct())
    return docs.join(bad.withColumnRenamed("doc_id", name), F.col("doc_id") == F.col(name), "left_anti")
