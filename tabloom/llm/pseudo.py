"""LM scoring by masked pseudo-likelihood: a bidirectional window network in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _groups
from .common import Memo, stage, text_or_empty

_BLANKS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")      # that str.split knows beside ASCII's
_ROWS = 1 << 10               # tokens whose logits are held at once: they fit the cache
_SAFE = 40                    # exp of logits within it, and products of two sums of such, are normal floats


def _plain(text: str) -> str | None:
    """The lower-cased text with ASCII blanks only, and none at its ends; None without words."""
    text = text.lower().strip()
    return (" ".join(text.split()) if _BLANKS.search(text) else text) or None


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, lower-cased and split as Python does: how many a text has,
    the place of each in the distinct words, and those. No string is made for a word;
    what follows works once a distinct word."""
    split = pc.ascii_split_whitespace(pa.array([_plain(x) for x in texts.to_pylist()], pa.string()))
    coded = split.flatten().dictionary_encode()
    return pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands in ``among``; -1 if it doesn't."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


class Vocabulary(Memo):
    """word -> id: frequent words have ids of their own, the others share classes by
    the hash of their last two letters."""

    def __init__(self, words: list[str], classes: int):
        super().__init__(500_000)
        self.words, self.classes, self.endings = {w: i for i, w in enumerate(words)}, classes, Memo(500_000)
        self.size, self.own = len(words) + classes, pa.array(words, pa.string())

    def _class_of(self, ending: str) -> int:
        found = self.endings.get(ending)
        if found is None:
            self.endings.make_room(1)
            found = self.endings[ending] = len(self.words) + zlib.crc32(ending.encode()) % self.classes
        return found

    def id_of(self, word: str) -> int:
        found = self.words.get(word)
        return self._class_of(word[-2:]) if found is None else found

    def ids_of(self, words: pa.Array) -> np.ndarray:
        """The ids of many words; their classes are looked up once a distinct ending."""
        found, endings = _places(words, self.own), pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        classes = np.fromiter(map(self._class_of, endings.dictionary.to_pylist()), dtype=np.int32, count=len(endings.dictionary))
        return np.where(found >= 0, found, classes[endings.indices.to_numpy()])

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.id_of(word)
        return found

    def ids(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n in _groups(batch.column("text"), 1 << 22):
            _, at, words = _words(batch.column("text").slice(first, n))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every lower-cased word of all texts."""
    return (docs.select(text_or_empty().alias("text")).mapInArrow(_word_counts, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame, count: int) -> list[str]:
    """The ``count`` most frequent words (ties by word)."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(count).collect()]


class WithinClass:
    """log P(word | its class) of every word, from the counts of the whole corpus.

    A word of a class has n / (N + 1), n its count and N that of its class; a word
    with an id of its own has 1. What is left, 1 / (N + 1), is for words that the
    corpus lacks, spelled by even odds on 256 bytes and an end. ``counts`` stays a
    table; the driver holds only the classes' counts and the words that make up at
    least a ``head``-th of all tokens, which are at most ``head``.
    """

    def __init__(self, counts: DataFrame, frequent: list[str], classes: int, head: int):
        rare = (counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in frequent], "word string")), "word", "left_anti")
                .withColumn("class", F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(classes))))
        total = np.zeros(len(frequent) + classes)
        for r in rare.groupBy("class").agg(F.sum("n").alias("n")).collect():
            total[len(frequent) + r["class"]] = r["n"]
        self.log_total = np.log1p(total)
        whole = int(counts.agg(F.sum("n")).first()[0] or 0)
        top = rare.where(F.col("n") >= F.lit(whole / head)).select("word", "n").collect()
        self.known = {r["word"]: float(np.log(r["n"])) for r in top} | dict.fromkeys(frequent, 0.0)
        self.counts = counts


def _log_count():
    """log of a word's count, or of its spelling if the corpus lacks it."""
    return F.coalesce(F.log("n"), -(F.octet_length("word") + 1) * F.lit(float(np.log(257))))


def _sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each row: along short rows a product with ones is the quicker way."""
    return rows @ np.ones(rows.shape[1], rows.dtype)


class WindowNetwork:
    """Predicts a token from ``radius`` tokens on both sides; the token itself is masked.

    Embeddings of the context, one tanh layer, then a softmax in two levels: over
    ``groups`` of outcomes (outcome i is in group i mod groups), and over the members
    of the token's own group, so a token costs two short softmaxes instead of one over
    the vocabulary. Beyond a text's ends stands a padding token.
    """

    def __init__(self, vocabulary: int, radius: int = 2, width: int = 16, hidden: int = 32, groups: int = 16, seed: int = 11):
        r = np.random.default_rng(seed)
        self.v, self.radius, self.width, self.groups = vocabulary, radius, width, min(groups, max(vocabulary, 1))
        members = -(-vocabulary // self.groups)
        absent = np.arange(members)[None, :] * self.groups + np.arange(self.groups)[:, None] >= vocabulary
        self.params = [r.normal(0, 0.1, (vocabulary + 1, width)), r.normal(0, (2 * radius * width) ** -0.5, (2 * radius * width, hidden)), np.zeros(hidden),
                       r.normal(0, hidden ** -0.5, (hidden, self.groups)), np.zeros(self.groups),
                       r.normal(0, hidden ** -0.5, (self.groups, hidden, members)), np.where(absent, -1e4, 0.0)]      # no odds for places without an outcome
        self.params = [p.astype(np.float32) for p in self.params]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> "WindowNetwork":
        at = 0
        for i, p in enumerate(self.params):
            self.params[i] = flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def contexts(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """One row of 2 * radius neighbours for each token of a text, or of texts of these
        sizes one after the other."""
        r, sizes = self.radius, np.array([len(ids)]) if sizes is None else sizes
        at = np.arange(len(ids)) + r * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        line = np.full(len(ids) + r * (len(sizes) + 1), self.v, dtype=np.int32)         # paddings between the texts
        line[at] = ids
        return np.stack([line[at + k] for k in range(-r, r + 1) if k], axis=1)

    def _hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emb, w1, b1 = self.params[:3]
        x = emb.take(ctx, axis=0).reshape(len(ctx), -1)
        h = x @ (2 * w1)                       # tanh(z) = 1 - 2 / (exp(2z) + 1)
        h += 2 * b1
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        return x, h

    def _by_group(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of the tokens by group, and (group, first, end) of each group in it."""
        group = (ids % self.groups).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        return order, [(g, first, end) for g, (first, end) in enumerate(zip([0, *ends], ends)) if end > first]

    def _odds(self, h: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all groups and of the own group's members, for rows in group order."""
        wg, bg, wm, bm = self.params[3:]
        members = np.empty((len(h), bm.shape[1]), dtype=h.dtype)
        for g, first, end in spans:
            np.dot(h[first:end], wm[g], out=members[first:end])
        members += np.repeat(bm[[g for g, _, _ in spans]], [end - first for _, first, end in spans], axis=0)
        logits = h @ wg
        logits += bg
        for z, w, b in ((logits, wg, bg), (members, wm, np.where(bm < -1e3, 0.0, bm))):
            if (np.abs(w).sum(axis=-2) + np.abs(b)).max() > _SAFE:             # |h| <= 1: beyond it no logit lies
                z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]            # along short rows it is slow
        return logits, members

    def log_probs(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every token given both sides."""
        out = np.empty(len(ids))
        for k in range(0, len(ids), _ROWS):
            some = ids[k:k + _ROWS]
            order, spans = self._by_group(some)
            logits, members = self._odds(self._hidden(ctx[k:k + _ROWS].take(order, axis=0))[1], spans)
            at = np.arange(len(some))
            some = some[order]
            hit = logits.take(at * logits.shape[1] + some % self.groups) + members.take(at * members.shape[1] + some // self.groups)
            both = _sums(np.exp(logits, out=logits)) * _sums(np.exp(members, out=members))
            out[k + order] = hit - np.log(both)
        return out

    def train(self, ctx: np.ndarray, ids: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step on the mean negative log-probability."""
        emb, w1, _, wg, _, wm, bm = self.params
        order, spans = self._by_group(ids)
        ctx, ids = ctx.take(order, axis=0), ids[order]
        n, at = len(ids), np.arange(len(ids))
        x, h = self._hidden(ctx)
        p, q = self._odds(h, spans)
        for z, hit in ((p, ids % self.groups), (q, ids // self.groups)):
            np.exp(z, out=z)
            z *= (1 / (n * _sums(z)))[:, None]
            z.reshape(-1)[at * z.shape[1] + hit] -= 1 / n
        dwm, dbm, back = np.zeros_like(wm), np.zeros_like(bm), np.ascontiguousarray(wm.transpose(0, 2, 1))
        dh = np.empty_like(h)
        for g, first, end in spans:
            np.dot(q[first:end], back[g], out=dh[first:end])
            np.dot(h[first:end].T, q[first:end], out=dwm[g])
        dbm[[g for g, _, _ in spans]] = np.add.reduceat(q, [first for _, first, _ in spans], axis=0)
        dh += p @ wg.T
        dh *= 1 - h * h
        dx = (dh @ w1.T).reshape(-1, self.width)
        cells = ctx.ravel()
        by_cell = np.argsort(cells.astype(np.uint16) if self.v < 1 << 16 else cells, kind="stable")
        sorted_cells = cells[by_cell]
        starts = np.concatenate(([0], np.flatnonzero(sorted_cells[1:] != sorted_cells[:-1]) + 1))
        demb = np.zeros_like(emb)
        demb[sorted_cells[starts]] = np.add.reduceat(dx.take(by_cell, axis=0), starts, axis=0)
        grad = np.concatenate([g.ravel() for g in (demb, x.T @ dh, _sums(dh.T), h.T @ p, _sums(p.T), dwm, dbm)])
        state["t"] = t = state.get("t", 0) + 1
        m, s = state.setdefault("m", np.zeros_like(grad)), state.setdefault("s", np.zeros_like(grad))
        m *= 0.9
        m += 0.1 * grad
        grad *= grad
        s *= 0.99
        s += 0.01 * grad
        step = np.sqrt(s * (1 / (1 - 0.99 ** t)))
        step += 1e-8
        np.divide(m, step, out=step)
        step *= rate / (1 - 0.9 ** t)
        first = 0
        for w in self.params:
            w -= step[first:first + w.size].reshape(w.shape).astype(w.dtype, copy=False)
            first += w.size


def _trainer(words, classes, shape, weights, every: int, batch_size: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value, classes)
        net, state, seen = WindowNetwork(vocabulary.size, **shape).load(weights.value), {}, 0
        ctx, ids, held = [], [], 0
        for batch in batches:
            for first, n in _groups(batch.column("text"), 1 << 20):
                sizes, at, distinct = _words(batch.column("text").slice(first, n))
                mine = vocabulary.ids_of(distinct)[at]
                near = net.contexts(mine, sizes)
                if every > 1:
                    pick = np.concatenate([np.arange(s % min(every, max(1, s)), s, every) + end - s for s, end in zip(sizes, np.cumsum(sizes))])
                    near, mine = near[pick], mine[pick]
                ctx.append(near)
                ids.append(mine)
                held += len(mine)
                if held >= batch_size:
                    all_ctx, all_ids = np.concatenate(ctx), np.concatenate(ids)
                    whole = held // batch_size * batch_size
                    for k in range(0, whole, batch_size):
                        net.train(all_ctx[k:k + batch_size], all_ids[k:k + batch_size], state, rate)
                    seen += whole
                    ctx, ids, held = [all_ctx[whole:]], [all_ids[whole:]], held - whole
        if held:
            net.train(np.concatenate(ctx), np.concatenate(ids), state, rate)
            seen += held
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.flat().astype(np.float64)], pa.list_(pa.float64()))],
                                             names=["n", "params"])
    return run


def fit(docs: DataFrame, words: int = 192, classes: int = 64, rounds: int = 4, every: int = 1, batch_size: int = 1024,
        rate: float = 4e-3, head: int = 1 << 17, **shape) -> tuple[list[str], int, dict, np.ndarray, WithinClass]:
    """(frequent words, classes, shape, weights, odds within the classes) learnt from
    all documents.

    The corpus falls into ``rounds`` parts by the hash of the text. In each round
    every task trains a copy of the network on its rows of that part, at all
    positions of each document (or each ``every``-th, one at least), and the copies'
    weights are averaged by
    the positions they saw: what comes back has the network's size, not the data's.
    The counts of all words, which grow with the corpus, stay a table.
    """
    sc = docs.sparkSession.sparkContext
    counts = stage(word_counts(docs))
    frequent = frequent_words(counts, words)
    weights = WindowNetwork(len(frequent) + classes, **shape).flat().astype(np.float64)
    shared = sc.broadcast(frequent)
    texts = docs.select(text_or_empty().alias("text"))
    for r in range(rounds):
        part = texts.where(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(rounds)) == r)
        run = _trainer(shared, classes, shape, sc.broadcast(weights), every, batch_size, rate)
        mean = (part.mapInArrow(run, "n long, params array<double>")
                .select("n", F.posexplode("params").alias("at", "value"))
                .groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).toPandas())
        if len(mean):
            weights = weights.copy()
            weights[mean["at"].to_numpy()] = mean["value"].to_numpy()
    return frequent, classes, shape, weights, WithinClass(counts, frequent, classes, head)


def _scorer(words, classes, shape, weights, known, log_total):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words.value, classes)
        net = WindowNetwork(vocabulary.size, **shape).load(weights.value)
        held, logs_held = pa.array(list(known.value), pa.string()), np.array([*known.value.values(), np.nan])

        def score(some):
            sizes, at, distinct = _words(some.column("text"))
            ids, counted = vocabulary.ids_of(distinct)[at], logs_held[_places(distinct, held)][at]          # -1: the NaN at the end
            far = np.isnan(counted)
            logs = net.log_probs(net.contexts(ids, sizes), ids) - log_total[ids] + np.where(far, 0.0, counted)
            tails = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[far], minlength=len(sizes)))))
            ends = np.concatenate(([0.0], np.cumsum(logs)))[np.concatenate(([0], np.cumsum(sizes)))]
            return pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes), pa.array(np.diff(ends)),
                                               pa.ListArray.from_arrays(pa.array(tails, pa.int32()), distinct.take(pa.array(at[far])))],
                                              names=["doc_id", "n_tokens", "near", "tail"])
        for batch in batches:
            for first, n in _groups(batch.column("text"), 1 << 21):            # by bytes, however long the texts
                yield score(batch.slice(first, n))
    return run


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob): the sum over a text's tokens
    of the log-probability of each given both sides, and its mean (null if no token).

    A token's probability is that of its word or class by the network, times that of
    the word within its class (``WithinClass``). Counts that tasks don't hold come by
    a join on the word.

    Null and empty texts have no token and sum 0; repeated rows come back repeated;
    further columns are ignored; an empty table stays empty.
    """
    sc = docs.sparkSession.sparkContext
    frequent, classes, shape, weights, within = model
    near = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                 .mapInArrow(_scorer(sc.broadcast(frequent), classes, shape, sc.broadcast(weights), sc.broadcast(within.known), within.log_total),
                             "doc_id long, n_tokens long, near double, tail array<string>")
                 .withColumn("row", F.monotonically_increasing_id()))
    far = (near.select("row", F.explode("tail").alias("word")).join(within.counts, "word", "left")         # none is frequent in the corpus
           .groupBy("row").agg(F.sum(_log_count()).alias("far")))
    total = F.col("near") + F.coalesce("far", F.lit(0.0))
    return (near.join(far, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
            .withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))))
