import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabloom.llm import sharding as S


def lpt(sizes, shards):
    load, out = [0] * shards, {}
    for size, name in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda i: (load[i], i))
        out[name] = s
        load[s] += size
    return out


def test_schedule():
    rng = random.Random(3)
    sizes = [(rng.randint(1, 50), f"g{i}") for i in range(300)]
    assert S.schedule(sizes, 7) == lpt(sizes, 7) and S.schedule([], 3) == {}


def _check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    home = defaultdict(set)
    for r in got:
        home[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    return Counter({s: sum(r.size for r in got if r.shard == s) for s in by})


def test_rows(spark, odd_docs, no_docs):
    _check([(r.doc_id, r.text) for r in odd_docs.collect()], S.assign_shards(odd_docs, 4).collect(), 4)
    assert S.assign_shards(no_docs).count() == 0


def test_small_tables_get_the_exact_schedule(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 150)) for i in range(300)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    import hashlib
    size = Counter()
    for _, t in rows:
        size[hashlib.sha256(t.encode()).hexdigest()] += len(t) + 1
    want = lpt([(n, g) for g, n in size.items()], 5)
    assert {(i, want[hashlib.sha256(t.encode()).hexdigest()]) for i, t in rows} == {(r.doc_id, r.shard) for r in got}


def _dealt(load, count, size):
    plan = S.deal(load, count, size)
    ends = [r for r, _ in plan[1:]] + [count]
    return [turn[(r - first) % len(turn)] for (first, turn), end in zip(plan, ends) for r in range(first, end)]


def test_deal_is_the_schedule_of_equal_items():
    rng = random.Random(8)
    for _ in range(300):
        shards, size = rng.randint(1, 6), rng.choice([1, 3, 7, 10])
        load = [rng.choice([0, rng.randint(0, 60)]) for _ in range(shards)]
        count = rng.randint(0, 50)
        got = _dealt(load, count, size)
        assert len(got) == count
        mine, want = list(load), list(load)
        for s in got:
            mine[s] += size
        for _ in range(count):
            want[min(range(shards), key=lambda i: (want[i], i))] += size
        assert sorted(mine) == sorted(want), (load, count, size, got)


def test_small_groups_go_by_size(spark):
    rng = random.Random(5)
    rows = [(i, "hot text" if i % 3 == 0 else f"{i} " + "y" * rng.choice([1, 5, 200, rng.randint(1, 900)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.assign_shards(df, 8, units=64).collect()
    load = _check(rows, got, 8)
    assert max(load.values()) - min(load.values()) < 0.002 * sum(load.values()) / 8
    size = Counter()
    for _, t in rows:
        size[t] += len(t) + 1
    best = Counter()
    for t, s in lpt([(n, t) for t, n in size.items()], 8).items():
        best[s] += size[t]
    assert max(load.values()) <= max(best.values()) * 1.002
    shard = {r.doc_id: r.shard for r in got}
    longest = sorted((t for t in size if t != "hot text"), key=lambda t: -size[t])[:200]       # neighbours in size go to different shards
    homes = [shard[int(t.split()[0])] for t in longest]
    assert max(Counter(homes).values()) <= 60
    own = S.assign_shards(df, 8, group=F.col("doc_id").cast("string"))
    assert own.count() == 6000


def test_many_small_groups(spark):
    df = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string"), F.repeat(F.lit("z"), (F.col("id") % 50).cast("int"))).alias("text"))
    loads = [r["b"] for r in S.assign_shards(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 200
