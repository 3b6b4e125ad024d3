"""G08 against numpy: weights, explained variance and components."""

import re
from collections import Counter

import numpy as np

from tabloom.operators.tfidf import fit_tfidf


def plain(cells, max_features):
    docs = [[t for t in re.split(r"[^\w]+", (c or "").lower()) if len(t) >= 2] for c in cells]
    tf, df = Counter(t for d in docs for t in d), Counter(t for d in docs for t in set(d))
    vocab = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:max_features])
    idf = np.array([np.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab])
    x = np.array([[d.count(t) for t in vocab] for d in docs], dtype=float).reshape(len(docs), len(vocab)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return vocab, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def test_weights_and_components(spark):
    rng = np.random.default_rng(3)
    words = [f"Word{i}" for i in range(30)] + ["x", "\u00c9t\u00e9"]
    cells = ["; ".join(" ".join(rng.choice(words, rng.integers(1, 4), p=None)) for _ in range(rng.integers(1, 6))) for _ in range(150)]
    cells += [None, "", " ; ;", "x;y", "only;rare;terms", "Word1;" * 5_000, cells[0]] + ["Word2;Word2;Word3"] * 80      # a hot cell
    df = spark.createDataFrame(list(enumerate(cells)), "id long, cell string")
    vocab, x = plain(cells, 20)
    fitted = fit_tfidf(df, "cell", n_components=4, max_features=20)
    assert fitted.vocab == vocab
    got = np.zeros_like(x)
    rows = fitted.with_weights(df, ["id"]).collect()
    assert len(rows) == len(cells)
    for r in rows:
        assert [e["i"] for e in r["_w"]] == sorted({e["i"] for e in r["_w"]}) and all(e["x"] > 0 for e in r["_w"])
        for e in r["_w"]:
            got[r["id"], e["i"]] = e["x"]
    assert np.allclose(got, x, atol=1e-12)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(cells) - 1))
    order = np.argsort(-values)[:4]
    assert np.allclose(fitted.explained_variance_ratio, values[order] / values.sum())
    want = centred @ vectors[:, order]
    out = fitted.transform(df)
    assert out.columns == ["id"] + [f"cell_tfidf_comp_{i}" for i in range(1, 5)]
    have = np.array([list(r)[1:] for r in sorted(out.collect())])
    signs = np.sign((have * want).sum(axis=0))
    assert np.allclose(have, want * signs, atol=1e-9)


def test_no_terms(spark):
    for cells in ([None, "", "x"], []):
        df = spark.createDataFrame(list(enumerate(cells)), "id long, cell string")
        fitted = fit_tfidf(df, "cell")
        assert fitted.vocab == [] and fitted.transform(df).count() == len(cells)
        assert all(r["_w"] == [] for r in fitted.with_weights(df, ["id"]).collect())
