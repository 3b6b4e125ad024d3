import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing as M
from tabloom.llm.prefix import in_order, prefix_sums
from tabloom.llm.queries import QUERIES


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Round by round, as the contract says it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(w[s] for s in open_)
        for s in open_:
            got[s] += left * w[s] / whole
        left = sum(max(0.0, got[s] - cap * sizes[s]) for s in names)
        for s in names:
            got[s] = min(got[s], cap * sizes[s])
        open_ = {s for s in open_ if got[s] < cap * sizes[s]}
    return got


def brute(rows, **how):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    goal = targets(dict(sizes), **how)
    out = []
    for i, text, source in rows:
        rate = goal[source] / sizes[source] if sizes[source] else 0.0
        name = ("" if i is None else str(i)) + ":" + hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((i, source, words(text), sizes[source], goal[source], math.floor(rate + 1e-12) + (u < rate - math.floor(rate + 1e-12))))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [(*r[:4], r[5]) for r in got] == [(*r[:4], r[5]) for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])


def _corpus(n=900):
    rng = random.Random(7)
    names = ["a", "B", "é", "z" * 3, "", None, "src10", "src9"]
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))), "a" if i % 3 == 0 else rng.choice(names)) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"weights": (1,), "share": 0.5, "cap": 1.0}, {"weights": (9, 1), "share": 1.9, "cap": 2.0}])
def test_against_rounds(spark, how):
    rows = _corpus()
    same(M.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), **how).collect(), brute(rows, **how))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    same(M.mixture(odd_docs).collect(), brute(rows))
    assert M.mixture(no_docs).count() == 0 and M.mix(no_docs).count() == 0
    taken = M.mix(odd_docs)
    assert taken.columns == odd_docs.columns
    assert Counter((r.doc_id, r.text) for r in taken.collect()) == Counter({k: v for k, v in Counter(
        {k: sum(r[5] for r, s in zip(brute(rows), rows) if (s[0], s[1]) == k) for k in {(r[0], r[1]) for r in rows}}).items() if v})


def test_words_and_white_space(spark):
    texts = ["", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "a b c", "x y", "\x1c\x1f z", "a\n\nb\tc", "$1 \\ x", None, "𝒳 𝒴"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.word_count().alias("n")).collect()
    assert [(r.text, r.n) for r in got] == [(t, words(t)) for t in texts]


def test_no_source_has_words(spark):
    got = M.mixture(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.copies) for r in got] == [(0.0, 0), (0.0, 0)]


def test_reruns_agree_and_totals_come_near(spark):
    docs = spark.createDataFrame(_corpus(6000), "doc_id long, text string, source string")
    first = M.mixture(docs)
    a, b = sorted(first.collect(), key=str), sorted(M.mixture(docs.repartition(13)).collect(), key=str)
    assert a == b and max(r.copies for r in a) <= 2
    per = first.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("target")).collect()
    assert all(abs(r.got - r.target) < 0.12 * r.target for r in per)


def test_native_plan(spark):
    from tests.conftest import SMOKE
    plan = QUERIES["op13_source_mixing"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "k", "hot", "hot"]), i, rng.randint(0, 9)) for i in range(500)]
    df = in_order(spark.createDataFrame(rows, "key string, i long, v long"), F.col("i"))
    got = {(r.key, r.i): (r.s, r.n) for r in prefix_sums(df, {"s": F.col("v"), "n": F.lit(1)}, [F.col("i")], ["key"]).collect()}
    sums, want = Counter(), {}
    for k, i, v in rows:
        want[(k, i)] = (sums[k, "s"], sums[k, "n"])
        sums[k, "s"] += v
        sums[k, "n"] += 1
    assert got == want
