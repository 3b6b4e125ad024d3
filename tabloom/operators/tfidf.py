"""TF-IDF of multi-value cells, then PCA components.

- Each row's text is its parts joined by spaces; tokens are lower-cased words
  of two or more word characters.
- Vocabulary: the ``max_features`` terms of largest total count (count desc,
  term asc); one exploded ``groupBy`` counts terms and the rows that hold them,
  only the chosen terms reach the driver.
- Weights: raw count x smooth idf ln((1 + n) / (1 + df)) + 1, then L2-normalised
  per row; a sparse vector, or array of (i, x), i the place in the vocabulary, by
  Spark ML's CountVectorizer, so the work grows with a cell's tokens.
- PCA: centred, from the covariance. The Gramian is summed inside the tasks from
  the sparse rows (``RowMatrix``), so no pair of terms becomes a row; the p x p result (p <= max_features) is decomposed on the driver.
  Each component's largest-magnitude loading is made positive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.multivalue import parts
from tabloom.operators.schema import q

NON_WORD = r"[^\p{L}\p{N}_]+"


def tokens(col: str, sep: str = ";") -> Column:
    """Lower-cased runs of >= 2 word characters (letters, digits, '_')."""
    text = F.lower(F.array_join(parts(col, sep), " "))
    return F.filter(F.split(text, NON_WORD), lambda x: F.length(x) >= 2)


@dataclass
class FittedTfidf:
    vocab: list[str]
    idf: list[float]
    mean: list[float]
    components: list[list[float]]     # n_components x p
    explained_variance_ratio: list[float]
    col: str
    sep: str = ";"

    def with_weights(self, df: DataFrame, keep: list[str], out: str = "_w") -> DataFrame:
        """The kept columns and ``out``: the L2-normalised tf-idf weights of the row as an
        array of (i, x) in vocabulary order, without zeros; empty for null and empty cells
        and for those that hold no term of the vocabulary."""
        cols = [q(c) for c in keep]
        if not self.vocab:
            return df.select(*cols, F.array().cast("array<struct<i:int,x:double>>").alias(out))
        sparse = F.unwrap_udt(F.col("_w"))
        pair = lambda i, x: F.struct(i.alias("i"), x.alias("x"))
        return self.with_vectors(df, cols).select(*cols, F.zip_with(sparse["indices"], sparse["values"], pair).alias(out))

    def with_vectors(self, df: DataFrame, cols: Sequence[Column]) -> DataFrame:
        """The columns and ``_w``: the same weights as a sparse vector; terms are looked up in a
        hash table of the vocabulary."""
        words = df.select(*cols, F.coalesce(tokens(self.col, self.sep), F.array().cast("array<string>")).alias("_tokens"))
        counted = CountVectorizerModel.from_vocabulary(self.vocab, inputCol="_tokens", outputCol="_tf").transform(words)
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_x").transform(counted)
        return Normalizer(p=2.0, inputCol="_x", outputCol="_w").transform(weighted).drop("_tokens", "_tf", "_x")

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = keep if keep is not None else [c for c in df.columns if c != self.col]
        staged = self.with_weights(df, keep).select(*[q(c) for c in keep], _once(F.col("_w"), "_w"))
        comps = []
        for i, comp in enumerate(self.components):
            loadings = F.array(*[F.lit(float(v)) for v in comp])
            centre = float(np.dot(self.mean, comp))
            dot = F.aggregate("_w", F.lit(-centre), lambda acc, e: acc + e["x"] * F.get(loadings, e["i"]))
            comps.append(dot.alias(f"{self.col}_tfidf_comp_{i + 1}"))
        return staged.select(*[q(c) for c in keep], *comps)


def _once(value: Column, name: str) -> Column:
    """The value as a column that later expressions read instead of working it out again."""
    return F.explode(F.array(value)).alias(name)


def _runs(df: DataFrame, cols: Sequence[Column], ordered: Column) -> DataFrame:
    """The columns with _h, a sorted array (null counts as empty), and _s, where its runs begin."""
    held = df.select(*cols, _once(ordered, "_h"))
    places = F.when(F.size("_h") > 0, F.sequence(F.lit(0), F.size("_h") - 1))
    starts = F.filter(places, lambda p: (p == 0) | (F.get(F.col("_h"), p) != F.get(F.col("_h"), p - 1)))
    return held.select(*cols, "_h", _once(F.coalesce(starts, F.array().cast("array<int>")), "_s"))


def _counts() -> Column:
    """(of, n) for each run of _h: its value and its length."""
    return F.transform("_s", lambda s, k: F.struct(F.get(F.col("_h"), s).alias("of"),
                                                  (F.coalesce(F.get(F.col("_s"), k + 1), F.size("_h")) - s).alias("n")))


def fit_tfidf(df: DataFrame, col: str, n_components: int = 10, max_features: int = 100, sep: str = ";"
              ) -> FittedTfidf:
    n = df.count()
    runs = _runs(df, [], F.array_sort(tokens(col, sep))).select(F.inline(_counts()))
    stats = runs.groupBy(F.col("of").alias("term")).agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    top = stats.orderBy(F.desc("tf"), "term").limit(max_features).collect()
    vocab = sorted(r["term"] for r in top)
    dfs = {r["term"]: r["df"] for r in top}
    idf = [float(np.log((1 + n) / (1 + dfs[t])) + 1) for t in vocab]
    plan = FittedTfidf(vocab, idf, [], [], [], col, sep)
    p = len(vocab)
    # one pass for the column sums and the Gramian: sparse rows of (1, weights).
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    whole = np.zeros((p + 1, p + 1))
    if p:
        rows = plan.with_vectors(df, [F.array(F.lit(1.0)).alias("_one")])
        rows = rows.select(array_to_vector("_one").alias("_one"), "_w")
        rows = VectorAssembler(inputCols=["_one", "_w"], outputCol="_row").transform(rows).select("_row")
        whole = RowMatrix(MLUtils.convertVectorColumnsFromML(rows), 0, p + 1).computeGramianMatrix().toArray()
    g, sums = whole[1:, 1:], whole[0, 1:]
    mean = sums / n
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(-vals)[:n_components]
    comps = vecs[:, order].T
    for k in range(comps.shape[0]):
        j = int(np.argmax(np.abs(comps[k])))
        if comps[k, j] < 0:
            comps[k] = -comps[k]
    total = float(vals.clip(min=0).sum()) or 1.0
    return FittedTfidf(vocab, idf, mean.tolist(), comps.tolist(),
                       [float(max(vals[i], 0) / total) for i in order], col, sep)
