"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, utf8

_LETTER = r"a-zÀ-ÿ"
_TOP = chr(0x10FFFF)             # after every letter
_PIECE = 1 << 20                 # characters of a text whose runs are listed at once
_FLUSH = 200_000                 # distinct words a task counts before it hands them on


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that cut no run of letters."""
    end_of_run = re.compile(f"[^{_LETTER}]")
    at = 0
    while len(text) - at > _PIECE:
        cut = end_of_run.search(text, at + _PIECE)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _count(least_length: int, damage: int):
    """Words of whole texts with their numbers, summed in the task."""
    runs = re.compile(f"[{_LETTER}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return done
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own: Counter = Counter()
                for piece in _pieces(text.as_py().lower().decode("utf-8", "replace")):      # bytes: A-Z only
                    own.update(runs.findall(piece))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if damage and h % damage == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1:]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) >= _FLUSH:
                    yield out()
        if total:
            yield out()
    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int = 199) -> DataFrame:
    """(word, n): the distinct words of whole texts and how often they occur.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.
    Where ``damage`` divides the crc32 of ``<doc_id>:<run>``, the run loses its code
    point at crc32 % length (0: never). Kept are results of at least
    ``least_length`` code points that occur ``least_count`` times. Null texts have
    no words, a null doc_id counts as an empty one, repeated rows count each time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    counted = rows.mapInArrow(_count(least_length, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- dynamic programming over a sorted list

def adjacent_lcps(words: list[str]) -> list[int]:
    """Length of the prefix that each word shares with the one before it."""
    out = [0] * min(len(words), 1)
    for a, b in pairwise(words):
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        out.append(k)
    return out


def _row(word: str, letter: str, d: int, row: tuple[int, int, int]) -> tuple[int, int, int]:
    """The band of row d of the edit matrix (against d-1, d, d+1 letters of ``word``)
    from that of row d - 1, where ``letter`` is the candidate's d-th; 2 is "too far"."""
    a, b, c = row
    n = len(word)
    x = min(a + (d < 2 or d - 2 >= n or letter != word[d - 2]), b + 1, 2) if d - 1 <= n else 2
    y = min(b + (letter != word[d - 1]), c + 1, x + 1, 2) if d <= n else 2
    z = min(c + (letter != word[d]), y + 1, 2) if d + 1 <= n else 2
    return x, y, z


def _dead_from(word: str, candidate: str, h: int) -> int:
    """Length of the shortest prefix of ``candidate`` that no word within one edit can
    begin with; 0 if there is none. Both share their first h letters."""
    row = (1, 0, 1)
    for d in range(h + 1, len(candidate) + 1):
        row = _row(word, candidate[d - 1], d, row)
        if min(row) > 1:
            return d
    return 0


def one_edit(words: list[str], lcps: list[int], word: str, h: int) -> list[int]:
    """Places in the sorted list of the words at exactly one edit from ``word`` that
    share its first h letters.

    Rows of the edit matrix are kept as far as the next candidate shares its prefix
    with this one (the adjacent LCP). A row without a cell of at most one ends all
    candidates with that prefix: the scan goes on after them.
    """
    i, end = bisect_left(words, word[:h]), bisect_left(words, word[:h] + _TOP)
    rows, found, n = [(1, 0, 1)], [], len(word)            # rows[k]: row h + k
    shared = h
    while i < end:
        candidate = words[i]
        del rows[shared - h + 1:]
        row, size = rows[-1], len(candidate)
        for d in range(h + len(rows), size + 1):
            row = _row(word, candidate[d - 1], d, row)
            if row[0] > 1 and row[1] > 1 and row[2] > 1:
                i = bisect_left(words, candidate[:d] + _TOP, i + 1, end)
                shared = lcps[i] if i < end else h
                break
            rows.append(row)
        else:
            if -1 <= n - size <= 1 and row[n - size + 1] == 1:
                found.append(i)
            i += 1
            shared = min(lcps[i], size) if i < end else h
    return found


def blocks_to_visit(firsts: list[str], word: str, h: int) -> list[int]:
    """The blocks of the sorted list (by their first words) that may hold a word within
    one edit that shares the first h letters. Blocks that lie wholly in a prefix
    more than one edit away are skipped in the same way."""
    at = max(bisect_right(firsts, word[:h]) - 1, 0)
    end = bisect_left(firsts, word[:h] + _TOP)
    visit, i = [at], at + 1
    while i < end:
        d = _dead_from(word, firsts[i], h)
        after = bisect_left(firsts, firsts[i][:d] + _TOP, i + 1, end) if d else i + 1
        visit.append(after - 1)                              # the last one reaches beyond the prefix
        i = after
    return visit


# ---- Spark side

_BLOCK = "block long, words array<string>, counts array<long>"
_FOUND = "word string, n_near long, form_n long, form string"


def _pack(size: int):
    """Blocks of neighbouring words; a block's number tells its partition and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, made = TaskContext.get().partitionId() << 32, 0
        words, counts = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([words], pa.list_(pa.string())),
                                               pa.array([counts], pa.list_(pa.int64()))], names=["block", "words", "counts"])
        for batch in batches:
            new_words, new_counts = batch.column("key").to_pylist(), batch.column("n").to_pylist()
            for k in range(0, len(new_words), size):
                words += new_words[k:k + size]
                counts += new_counts[k:k + size]
                while len(words) >= size:
                    rest = words[size:], counts[size:]
                    words, counts = words[:size], counts[:size]
                    yield out()
                    made += 1
                    words, counts = rest
        if words:
            yield out()
    return run


def _kept(word: str, backward: bool) -> int:
    """How many letters a pass holds fixed: the first half; from the end, the rest."""
    half = len(word) // 2
    return len(word) - half if backward else half


def _route(bounds, backward: bool, size: int):
    """Words as queries, in packs for each block that they must be looked up in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, firsts = bounds.value
        packs: dict[int, list[str]] = defaultdict(list)

        def out(b):
            return pa.RecordBatch.from_arrays([pa.array([numbers[b]], pa.int64()), pa.array([packs.pop(b)], pa.list_(pa.string()))],
                                              names=["to", "queries"])
        for batch in batches:
            for block in batch.column("words"):
                for word in block.as_py():
                    for b in blocks_to_visit(firsts, word, _kept(word, backward)):
                        packs[b].append(word)
                        if len(packs[b]) >= size:
                            yield out(b)
        for b in list(packs):
            yield out(b)
    return run


def _search(backward: bool):
    """Of every query: its near words in the block, counted, and the commonest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, counts, lcps = None, [], [], []
        for batch in batches:
            for k in range(len(batch)):
                block = batch.column("block")[k].as_py()
                if block != last:
                    last, words, counts = block, batch.column("words")[k].as_py(), batch.column("counts")[k].as_py()
                    lcps = adjacent_lcps(words)
                out = []
                for word in batch.column("queries")[k].as_py():
                    h = _kept(word, backward)
                    near = one_edit(words, lcps, word, h)
                    if backward:                      # those that share the first half belong to the forward pass
                        near = [i for i in near if words[i][::-1][:len(word) - h] != word[::-1][:len(word) - h]]
                    if near:
                        n, best = min((-counts[i], words[i][::-1] if backward else words[i]) for i in near)
                        out.append((word[::-1] if backward else word, len(near), -n, best))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                                     names=["word", "n_near", "form_n", "form"])
    return run


def near_words(words: DataFrame, block: int = 1 << 13) -> DataFrame:
    """(word, n_near, form_n, form) of (word, n): how many other words lie at exactly one
    inserted, deleted or replaced code point, and the commonest of them (ties: the
    smallest). A word may have several rows, each for a part of its near words;
    words without any have none. No pair is listed.

    An edit leaves a word's first half or its other half as it is. So the list is
    sorted forwards, to find partners with the same first half, and backwards, for
    the same second half but not the same first. A sorted list is cut into blocks of
    ``block`` words; a word meets its own block and those neighbours that its half
    reaches into, less the ones whose shared prefix is more than one edit away, so
    a half that a third of all words share doesn't bring all of them together. Only
    the blocks' first words (one in ``block`` words) are broadcast.
    """
    spark, sc, found = words.sparkSession, words.sparkSession.sparkContext, None
    for backward in (False, True):
        key = F.reverse("word") if backward else F.col("word")
        keyed = words.select(key.alias("key"), "n").repartitionByRange("key").sortWithinPartitions("key")
        blocks = stage(keyed.mapInArrow(_pack(block), _BLOCK))
        firsts = blocks.select("block", F.element_at("words", 1).alias("first")).orderBy("first").collect()   # a row a block
        if not firsts:
            return spark.createDataFrame([], _FOUND)
        bounds = sc.broadcast(([r["block"] for r in firsts], [r["first"] for r in firsts]))
        asked = blocks.select("words").mapInArrow(_route(bounds, backward, block), "to long, queries array<string>")
        tasks = -(-len(firsts) // 2)               # few bytes but much work: dealt by number of blocks, not by size
        met = (asked.repartition(tasks, "to").join(blocks.repartition(tasks, "block"), F.col("to") == F.col("block"))
               .select("block", "words", "counts", "queries"))
        part = met.mapInArrow(_search(backward), _FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last of the forms that follow from a word.
    Each round doubles the steps taken; it ends when no root has a form itself."""
    links = stage(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        links = stage(links.join(onward, F.col("root") == F.col("via"), "left")
                      .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def spelling_forms(words: DataFrame, factor: int = 5, block: int = 1 << 13) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), one row a word.

    ``form`` is the near word (see ``near_words``) with the largest n, ties to the
    smallest in code-point order, if that n is at least ``factor`` times the word's;
    else null, and ``form_n`` with it. ``root`` follows forms to the last, the word
    itself if it has none; counts grow along forms, so they never circle. Words are
    taken as distinct and not null; no words, no rows.
    """
    words = stage(words.select("word", "n"))
    parts = near_words(words, block).select("word", F.lit(None).cast("long").alias("n"), "n_near",
                                            F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")).alias("best"))
    all_words = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,form:string>").alias("best"))
    per = (all_words.unionByName(parts).groupBy("word")
           .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")))
    much = -F.col("best.less") >= F.lit(factor) * F.col("n")
    formed = stage(per.select("word", F.when(much, F.col("best.form")).alias("form"), "n", "n_near",
                              F.when(much, -F.col("best.less")).alias("form_n")))
    roots = follow(formed)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage: int = 199, factor: int = 5) -> DataFrame:
    """The words of ``docs`` (see ``vocabulary``) with their forms (``spelling_forms``).
    Empty tables, and tables without words, give an empty result."""
    return spelling_forms(vocabulary(docs, least_length, least_count, damage), factor)
