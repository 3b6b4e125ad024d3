import random
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from tabloom.llm import quality as Q

CLASH = "doc_id long, text string, quality int, score double, held_out int"


def _corpus(n=600):
    rng = random.Random(4)
    words = ["the", "river", "stone", "walk", "light", "garden", "often", "quiet", "morning", "letter"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        bad = i % 4 == 0
        if bad:
            text = text.upper() + "!!!" if i % 8 == 0 else " ".join(w for w in text.split()[:6] for _ in range(15))
        rows.append((i, text, 0, 0.1, 1))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = _corpus()
    odd = [(9001, None, 0, 0.0, 0), (9002, "", 0, 0.0, 0), (None, "no id", 0, 0.0, 0), (9003, "x" * 300_000, 0, 0.0, 0), (1, rows[1][1], 0, 0.0, 0)]
    docs = spark.createDataFrame(rows + odd, CLASH)
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, label int")
    out, model = Q.classify(docs, lab)
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 80 and sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.97
    # held-out labels teach nothing: turning them round changes no score
    turned = lab.withColumn("label", F.when(Q.held_out(), 1 - F.col("label")).otherwise(F.col("label")))
    again = Q.classify(docs, turned)[0].collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    # the compiled column equals the rules evaluated by hand
    stats = Q.with_statistics(docs).select("doc_id", "__stats", model.score().alias("s")).where("doc_id is not null").limit(50).collect()
    from math import exp
    for r in stats:
        total = model.intercept + sum(w for rule, w in model.rules
                                      if all(r["__stats"][n] <= t if s == "<=" else r["__stats"][n] > t for n, s, t in rule))
        assert abs(r.s - 1 / (1 + exp(-total))) < 1e-9
    kept = Q.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in got)


def _plain(text):
    """The statistics in Python, one by one."""
    from math import log1p
    words, lines, n = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" ")), text.split("\n"), max(len(text), 1)

    def chars(test):
        return sum(map(test, text)) / n
    return {"log_words": log1p(len(words)), "word_length": len(text) / len(words), "distinct_words": len(set(words)) / len(words),
            "repeated_words": sum(a == b for a, b in zip(words, words[1:])) / len(words), "distinct_lines": len(set(lines)) / len(lines),
            "line_length": log1p(len(text) / len(lines)), "capitals": chars(lambda c: unicodedata.category(c) == "Lu"),
            "letters": chars(lambda c: unicodedata.category(c)[0] == "L"), "digits": chars(lambda c: c in "0123456789"),
            "junk": chars(lambda c: c in "&#$%*"), "bangs": chars(lambda c: c == "!"), "pipes": chars(lambda c: c == "|"), "breaks": chars(lambda c: c == "\n")}


def test_statistics_against_python(spark):
    texts = ["", " ", "one", "a a a b b", "Ab CD\n\nAb CD\n\n9 | 10!! &#", "\u00c9t\u00e9 \u00dcber \u4e2d\u6587 \u0663 \u01c5", "no no\tno \n no", "x" * 100_000, "w \n" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.with_statistics(rows).collect():
        want = _plain(r.text)
        assert list(r["__stats"].asDict()) == list(want) == Q.STATISTICS
        for name, value in want.items():
            assert abs(r["__stats"][name] - value) < 1e-12, (r.text[:20], name, r["__stats"][name], value)


def test_keep_good_with_clashing_names(spark):
    rows, labels = _corpus(200)
    docs = spark.createDataFrame([(*r[:2], 1, 2) for r in rows] + [(None, None, 1, 2), (0, rows[0][1], 1, 2)],
                                 "doc_id long, text string, __stats int, `___STATS` int")
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    kept = Q.keep_good(docs, lab)
    assert kept.columns == docs.columns
    want = [r.doc_id for r in Q.classify(docs, lab)[0].where("predicted = 1").collect()]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect()) and 0 < len(want) < 202
    assert Q.keep_good(docs.where("false"), lab).collect() == []


def test_one_class_and_no_rows(spark):
    rows, labels = _corpus(40)
    docs = spark.createDataFrame(rows, CLASH)
    ones = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, label int")
    out, model = Q.classify(docs, ones)
    assert model.rules == () and out.where("score > 0.9").count() == 40
    out, model = Q.classify(docs, ones.where("false"))
    assert out.where("score = 0.5").count() == 40
    assert Q.classify(docs.where("false"), ones)[0].count() == 0


def test_tree_paths():
    text = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 3.0)
      Predict: 0.0
     Else (feature 0 > 3.0)
      Predict: 1.0
"""
    a, b = Q.STATISTICS[:2]
    assert set(Q.tree_paths(text)) == {((a, "<=", 1.5),), tuple(sorted([(a, "<=", 1.5), (b, "<=", 2.0)])), tuple(sorted([(a, "<=", 1.5), (b, ">", 2.0)])),
                                       ((a, ">", 1.5),), ((a, "<=", 3.0), (a, ">", 1.5)), ((a, ">", 3.0),)}
