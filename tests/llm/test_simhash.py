import random

import numpy as np
import xxhash

from tabloom.llm import simhash as S
from tabloom.llm.components import connected_components


def plain_print(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def classes(prints, d=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(spark, odd_docs, no_docs):
    for r in odd_docs.collect():
        assert S.fingerprint((r.text or "").encode()) == plain_print(r.text or "")
    for t in ("A b", "É É É É", "one\x1ctwo\xa0three four five", "x", "a b c", "tab\tnew\nline\x0bvt\x0cff\rcr"):
        assert S.fingerprint(t.encode()) == plain_print(t)
    assert S.near_duplicates(no_docs).count() == 0


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints = list({p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in base for _ in range(8)})
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for d in (0, 1, 3, 5):
        got = S.links(df, d).collect()
        pairs = {frozenset((r.a, r.b)) for r in got}
        want = {frozenset((int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))))
                for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= d}
        assert pairs == want and len(got) <= (d // 2 + 1) * max(1, len(want))


def test_classes_against_brute_force(spark, odd_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(400)]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n")] + [(2000 + i, "hot copy of one text that stands here again and again") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [plain_print(t or "") for _, t in rows]
    roots = classes(prints)
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]) for i in range(len(rows))}
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[rows[i][0]].fingerprint == f"{p:016x}" for i, p in enumerate(prints))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    odd = S.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns and sorted(str(r.doc_id) for r in odd.collect()) in (
        [["1", "2", "4", "5", "7", "None"], ["1", "2", "4", "7", "None"]])


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    edges += [(5, 5), (7, None), (1, 0), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
