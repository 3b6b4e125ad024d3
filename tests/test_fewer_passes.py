"""Steps that read or shuffle their rows once, with the rows they had before."""

from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32
from tabloom.operators import models as MD
from tabloom.operators import multivalue as G
from tabloom.operators import synth as L


def test_repeats_share_one_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(300)], "k long, v double")
    seeds = [4, 5, 6]
    got = MD.paired_repeats(df, ["v"], "k", seeds)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    have = {(r["_repeat"], r["k"]): r["_perm_v"] for r in got.collect()}
    assert len(have) == 900
    for i, s in enumerate(seeds):
        one, other = [[r["k"] for r in df.orderBy(mix32("k", x), "k").collect()] for x in (s, s + 100003)]
        assert all(have[i, a] == float(b * b) for a, b in zip(one, other))
    monkeypatch.setattr(MD, "ROWS_PER_BUCKET", 20)               # in buckets it is still a permutation
    rows = MD.paired_repeats(df, ["v"], "k", seeds).collect()
    for i in range(3):
        assert sorted(r["_perm_v"] for r in rows if r["_repeat"] == i) == [float(i * i) for i in range(300)]


def test_repeats_are_ranked_without_sorting_them(spark, monkeypatch):
    """Equal hashes go by the key, rows without a key drop out, and a bucket that is too large for an array has the same pairs."""
    keys = list(range(40)) + [(1 << 32) | (i ^ 1) for i in range(40)]           # mix32 folds a key: each hash occurs twice
    data = [(k, None if i % 7 == 0 else float(i), f"t{i}") for i, k in enumerate(keys)] + [(None, -1.0, "none")]
    df = spark.createDataFrame(data, "k long, `a.b` double, t string")
    plan = MD.paired_repeats(df, ["a.b", "t"], "k", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1

    def pairs():
        rows = MD.paired_repeats(df, ["a.b", "t"], "k", [1, 2]).collect()
        assert len(rows) == 160 and {tuple(r[:3]) for r in rows} == set(data[:-1])
        return {(r["_repeat"], r["k"]): (r["_perm_a.b"], r["_perm_t"]) for r in rows}
    held = pairs()
    by_key = {d[0]: d[1:] for d in data}
    for i, s in enumerate([1, 2]):
        one, other = [[r["k"] for r in df.where("k IS NOT NULL").orderBy(mix32("k", x), "k").collect()] for x in (s, s + 100003)]
        assert all(held[i, a] == by_key[b] for a, b in zip(one, other))
    monkeypatch.setattr(MD, "HELD", 0)
    assert pairs() == held
    text = df.select(F.concat(F.lit("x"), "k").alias("k"), "t")
    windows = MD.paired_repeats(text, ["t"], "k", [3]).collect()
    monkeypatch.undo()
    assert sorted(windows) == sorted(MD.paired_repeats(text, ["t"], "k", [3]).collect()) and len(windows) == 80
    assert MD.paired_repeats(df.limit(0), ["t"], "k", [3]).count() == 0


def test_permutation_scores_the_named_metric_of_every_repeat(spark):
    from tabloom.operators.metrics import regression_metrics
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), 2.0 * (i % 5) + i % 3) for i in range(60)], "k long, a double, b double, y double")
    model = MD.LinearScorer("m", {"a": 2.0, "b": 0.5}, 0.1)
    for metric in ("R2", "RMSE", "MAE"):
        base = regression_metrics(model.predict(df, "_p"), "y", "_p").first()[metric]
        got = {r["feature"]: r for r in MD.permutation_importance(df, model, "y", ["a", "b"], "k", n=3, metric=metric, seed=4).collect()}
        for f in ("a", "b"):
            drops = [base - regression_metrics(model.predict(MD.permute_column(df, f, "k", s), "_p"), "y", "_p").first()[metric] for s in (4, 5, 6)]
            mean = sum(drops) / 3
            assert abs(got[f]["mean_drop"] - mean) < 1e-12
            assert abs(got[f]["std_drop"] - (sum((d - mean) ** 2 for d in drops) / 3) ** 0.5) < 1e-12


def test_levels_are_drawn_without_sorting_the_draws(spark, monkeypatch):
    values = ["a"] * 700 + [f"v{i:03}" for i in range(300)]
    df = spark.createDataFrame([(i, v, float(i % 7)) for i, v in enumerate(values)], "id long, c string, x double")
    cop = L.fit_copula(df, "id")
    assert not hasattr(L, "last_at_or_before")
    u = spark.range(2000).select(F.col("id").alias("row_id"), ((F.col("id") + 0.5) / 2000).alias(f"_u{cop.columns.index('c')}"))
    for slots in (L.SLOTS, 7):
        monkeypatch.setattr(L, "SLOTS", slots)
        drawn = cop._drawn(u).orderBy("row_id").collect()
        assert [r[f"_v{cop.columns.index('c')}"] for r in drawn] == [sorted(values)[int((i + 0.5) / 2)] for i in range(2000)]
    assert cop.sample(spark, 500, 1).where(F.col("c").isNotNull()).count() == 500


def test_parts_are_counted_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b; a;a"), (2, None), (3, "b")], "k long, cell string")
    calls, counts = [], G.value_counts
    monkeypatch.setattr(G, "value_counts", lambda *a: (calls.append(a), counts(*a))[1])
    out, mapping = G.expand_multivalue(df, ["cell"], "count_features")
    assert len(calls) == 1 and mapping.count() == 4
    assert sorted(map(tuple, out.collect())) == [(1, 3, 2, 1, 2.0), (2, 0, 0, 0, 0.0), (3, 1, 1, 0, 2.0)]


def test_gramian_makes_no_rows_of_pairs(spark):
    from tabloom.operators.tfidf import fit_tfidf
    df = spark.createDataFrame([(1, "ab cd;ab"), (2, None), (3, "cd ef")], "k long, cell string")
    w = fit_tfidf(df, "cell", n_components=2).with_vectors(df, [F.col("k")])
    assert "Generate" not in w._jdf.queryExecution().executedPlan().toString()
    assert [r["_w"].numNonzeros() for r in w.orderBy("k").collect()] == [2, 0, 2]


def test_saved_models_are_scored_in_one_pass(spark):
    from tabloom.operators.metrics import regression_metrics
    df = spark.createDataFrame([(float(i), 2.0 * i + i % 3) for i in range(40)], "x double, y double")
    models = [MD.LinearScorer("a", {"x": 2.0}, 0.5), MD.LinearScorer("b", {"x": 1.0}, 3.0)]
    got = MD.scores_side_by_side(df, models, "y")
    for m in models:
        want = regression_metrics(m.predict(df, "_p"), "y", "_p").first()
        assert got[m.name]["n"] == 40 and abs(got[m.name]["R2"] - want["R2"]) < 1e-12 and abs(got[m.name]["RMSE"] - want["RMSE"]) < 1e-12
    assert MD.scores_side_by_side(df.limit(0), models, "y")["a"]["R2"] is None


def test_normalised_columns_are_not_normalised_again(spark):
    """Names done, text is lower and stripped: the cleaning of a value replaces only."""
    from tabloom.plans.preprocess import Preprocessor
    df = spark.createDataFrame([(1, " A-b ", "X-1; y ;x-1"), (2, None, None), (3, "c\t", "Y")], "id int, kind string, many string")
    fitted = Preprocessor(fill_value=" Not-Given ").fit(df)
    assert fitted.single_levels == {"kind": ["a_b", "c", "not_given"]} and fitted.multi_levels == {"many": ["not_given", "x_1", "y"]}
    out = fitted.transform(df)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0, 1, 1, 1, 0, 0), (2, 1, 0, 0, 0, 0, 1), (3, 0, 0, 1, 0, 1, 0)]
    cleaned = fitted._clean(fitted._names(df))._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count("lower(") == 2
    # a null token may be anything, so it is cleaned whole
    token = Preprocessor(null_token=" N-A").fit(df)
    assert token.single_levels == {"kind": ["a_b", "c", "n_a"]}
