import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tabloom.llm import pseudo as P


def _docs(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = []
        while len(words) < 120:
            a = rng.choice(["red", "blue", "green"])
            words += [a, "is" if a == "red" else "was", a + "ish"]
        rows.append((i, " ".join(words), "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_learns_both_sides(spark):
    rows, docs = _docs(spark)
    model = P.fit(docs, words=8, classes=4, rounds=4, every=2, batch_size=128, rate=0.02)
    got = {r.doc_id: r for r in P.score(docs, model).collect()}
    vocabulary = P.Vocabulary(model[0], model[1])
    ids = [vocabulary.ids(t) for _, t, _ in rows]
    n = np.bincount(np.concatenate(ids), minlength=vocabulary.size)
    unigram = (n[n > 0] * np.log(n[n > 0] / n.sum())).sum() / n.sum()
    mean = sum(r.log_likelihood for r in got.values()) / sum(r.n_tokens for r in got.values())
    assert mean > unigram / 2
    shuffled = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t, _ in rows], "doc_id long, text string")
    worse = {r.doc_id: r.log_likelihood for r in P.score(shuffled, model).collect()}
    assert sum(got[i].log_likelihood > worse[i] for i in got) > 0.95 * len(got)
    # the sum of conditionals, token by token
    net = P.WindowNetwork(vocabulary.size).load(model[3])
    d = ids[3]
    emb, w1, b1, wg, bg, wm, bm = net.params
    total = 0.0
    for t in range(len(d)):
        near = [d[t + o] if 0 <= t + o < len(d) else vocabulary.size for o in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([emb[j] for j in near]) @ w1 + b1)
        g = d[t] % net.groups
        for z, hit in ((h @ wg + bg, g), (h @ wm[g] + bm[g], d[t] // net.groups)):
            total += z[hit] - np.log(np.exp(z.astype(np.float64)).sum())
    assert abs(total - got[3].log_likelihood) < 1e-2


def test_gradient():
    net = P.WindowNetwork(7, radius=1, width=3, hidden=4, groups=3)
    net.params = [p.astype(np.float64) for p in net.params]
    ids = np.array([1, 2, 3, 1, 0, 6])
    ctx = net.contexts(ids)
    before = [p.copy() for p in net.params]
    state = {}
    net.train(ctx, ids, state, 0.0)
    first = 0
    for i, p in enumerate(before):
        grad = (state["m"][first:first + p.size] / 0.1).reshape(p.shape)
        first += p.size
        for at in [(0,) * p.ndim, tuple(s - 1 for s in p.shape), tuple(s // 2 for s in p.shape)]:
            step = 1e-6
            net.params[i][at] += step
            up = -net.log_probs(ctx, ids).mean()
            net.params[i][at] -= 2 * step
            down = -net.log_probs(ctx, ids).mean()
            net.params[i][at] += step
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5


def test_outcomes_are_a_distribution():
    for v in (1, 5, 16, 37, 256):
        net = P.WindowNetwork(v)
        ctx = np.repeat(net.contexts(np.zeros(3, dtype=np.int32))[1:2], v, axis=0)
        assert abs(np.exp(net.log_probs(ctx, np.arange(v))).sum() - 1) < 1e-5


def test_odd_rows(spark, odd_docs, no_docs):
    model = P.fit(odd_docs)
    got = P.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite(r.log_likelihood) for r in got)
    assert all((r.n_tokens == 0) == (r.mean_log_prob is None) for r in got)
    assert sum(r.n_tokens == 0 for r in got) == 3
    assert P.score(no_docs, P.fit(no_docs)).count() == 0


def test_every_word_has_its_own_probability(spark):
    rng = random.Random(5)
    rare = [f"{a}{b}ing" for a in "abcdefgh" for b in "klmno"] + ["x", "é", "größe", "weiße"]
    texts = [" ".join(rng.choice(["the", "of"]) if rng.random() < 0.4 else rng.choice(rare[:1 + i % len(rare)]) for _ in range(60)) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = P.fit(docs, words=2, classes=3)
    asked = [(0, "the akin of"), (1, "the aking of"), (2, "the hoing of"), (3, "the qqqqing of"), (4, "x é größe weiße"), (4, "x é größe weiße"), (5, "")]
    asked_docs = spark.createDataFrame(asked, "doc_id long, text string")
    got = sorted(tuple(r) for r in P.score(asked_docs, model).select("doc_id", "n_tokens", "log_likelihood").collect())
    # brute force: the network's share of the class and the word's share in it
    vocabulary = P.Vocabulary(model[0], model[1])
    net = P.WindowNetwork(vocabulary.size).load(model[3])
    n = Counter(w for t in texts for w in t.split())
    of = Counter()
    for w, k in n.items():
        of[vocabulary[w]] += k
    for (doc, text), (_, size, value) in zip(asked, got):
        ids, words = vocabulary.ids(text), text.split()
        total = net.log_probs(net.contexts(ids), ids).sum()
        for w, i in zip(words, ids.tolist()):
            if w not in model[0]:
                total += (np.log(n[w]) if w in n else -(len(w.encode()) + 1) * np.log(257)) - np.log(of[i] + 1)
        assert size == len(words) and abs(total - value) < 1e-3
    assert len({round(v, 6) for _, _, v in got}) == 6                   # junk with the same ending scores otherwise
    # the same from the joined table as from the words that tasks hold
    joined = (*model[:4], P.WithinClass(model[4].counts, model[0], model[1], head=1))
    assert len(model[4].known) == len(n) and len(joined[4].known) == 2
    again = sorted(tuple(r) for r in P.score(asked_docs, joined).select("doc_id", "n_tokens", "log_likelihood").collect())
    assert np.allclose([r[2] for r in got], [r[2] for r in again])


def test_trains_on_every_position(spark, monkeypatch):
    texts = ["a b c", "one", "w x y z q r s", " ".join(f"t{i}" for i in range(2500)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    vocabulary = P.Vocabulary(["a", "one", "q"], 4)
    trained = []
    monkeypatch.setattr(P.WindowNetwork, "train", lambda self, ctx, ids, state, rate: trained.extend(ids.tolist()))

    class Held:
        def __init__(self, value):
            self.value = value

    weights = P.WindowNetwork(vocabulary.size).flat()
    batches = [b for b in docs.select("text").toArrow().to_batches()]
    default = P.fit.__defaults__[P.fit.__code__.co_varnames[1:P.fit.__code__.co_argcount].index("every")]
    run = P._trainer(Held(["a", "one", "q"]), 4, {}, Held(weights), default, 1024, 4e-3)
    seen = sum(b.column("n")[0].as_py() for b in run(iter(batches)))
    assert trained == [int(i) for t in texts for i in vocabulary.ids(t)] and seen == len(trained)
    # every eighth position, and one at least
    trained.clear()
    list(P._trainer(Held(["a", "one", "q"]), 4, {}, Held(weights), 8, 1024, 4e-3)(iter(batches)))
    assert len(trained) >= 2500 // 8 + 3 and trained[:3] == [int(vocabulary.ids(t)[0]) for t in texts[:3]]
    # texts of a few words move the network
    before, after = P.WindowNetwork(4 + 2).flat(), P.fit(spark.createDataFrame([(1, "u v w")], "doc_id long, text string"), words=2, classes=4)[3]
    assert not np.allclose(before, after)


def test_tails_meet_their_counts_without_a_shuffle_of_their_own(spark):
    docs = spark.createDataFrame([(i, f"the w{i}x w{i}x of w{i % 7}y") for i in range(60)], "doc_id long, text string")
    model = P.fit(docs, words=2, classes=3, head=1)
    got = P.score(docs, model)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert all(r["n_tokens"] == 5 and np.isfinite(r["log_likelihood"]) for r in got.collect())
    # classes are looked up by ending, and the same as by hash
    vocabulary = P.Vocabulary(["the"], 64)
    for w in ("the", "king", "ring", "x", "g", "größe"):
        assert vocabulary[w] == vocabulary.id_of(w) == (0 if w == "the" else 1 + P.zlib.crc32(w[-2:].encode()) % 64)
    assert vocabulary["king"] == vocabulary["ring"] and len(vocabulary.endings) == 4


class _Held:
    def __init__(self, value):
        self.value = value


def test_words_are_those_of_python():
    rng = random.Random(3)
    letters = [c for c in map(chr, range(0x3100)) if c.isspace()] + list("aB é ßÇİΣσ\u200b\x00") + ["ab", "word"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["", " ", "  x"]
    sizes, at, distinct = P._words(pa.array(texts))
    wanted = [t.lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert distinct.take(pa.array(at)).to_pylist() == [w for ws in wanted for w in ws]
    vocabulary = P.Vocabulary(["ab", "a", "é"], 5)
    assert vocabulary.ids_of(distinct).tolist() == [vocabulary.id_of(w) for w in distinct.to_pylist()]
    assert len(P._words(pa.array(["", " "]))[2]) == len(vocabulary.ids_of(pa.array([], pa.string()))) == 0


def test_no_lookup_for_each_word(monkeypatch):
    texts = pa.array(["the king of the ring", "", "x größe the ring"])
    vocabulary = P.Vocabulary(["the"], 4)
    ids = [vocabulary.id_of(w) for t in texts.to_pylist() for w in t.split()]

    def never(self, word):
        raise AssertionError(word)

    for name in ("id_of", "__missing__"):
        monkeypatch.setattr(P.Vocabulary, name, never)
    weights = P.WindowNetwork(vocabulary.size).flat()
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], names=["doc_id", "text"])
    seen = list(P._trainer(_Held(["the"]), 4, {}, _Held(weights), 1, 4, 4e-3)(iter([rows])))
    assert seen[0].column("n").to_pylist() == [9]
    known = {"the": 0.0, "ring": float(np.log(2))}
    got = list(P._scorer(_Held(["the"]), 4, {}, _Held(weights), _Held(known), np.zeros(vocabulary.size))(iter([rows])))[0].to_pylist()
    net = P.WindowNetwork(vocabulary.size)
    for row, own, words in zip(got, (ids[:5], [], ids[5:]), (["king", "of"], [], ["x", "größe"])):
        own = np.array(own, dtype=np.int32)
        assert row["n_tokens"] == len(own) and row["tail"] == words
        expected = net.log_probs(net.contexts(own), own).sum() + (np.log(2) if len(own) else 0)
        assert abs(row["near"] - expected) < 1e-5


def test_large_logits_stay_finite():
    net = P.WindowNetwork(37)
    net.params = [p * (1 if i == 6 else 300) for i, p in enumerate(net.params)]
    ctx = np.repeat(net.contexts(np.zeros(3, dtype=np.int32))[1:2], 37, axis=0)
    found = net.log_probs(ctx, np.arange(37))
    assert np.isfinite(found).all() and abs(np.exp(found).sum() - 1) < 1e-5
