import random
import re
import zlib
from collections import Counter

from tabloom.llm import spelling as S

ROWS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_words(rows, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= least}


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if abs(len(v) - len(w)) <= 1 and v != w and distance(v, w) == 1)
        form[w] = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = (form[w], n, len(near), words[form[w]] if form[w] else None)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def mutated(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:i] + rng.choice(letters) + word[i:] if kind == 0 else word[:i] + word[i + 1:] if kind == 1 else word[:i] + rng.choice(letters) + word[i + 1:]


def some_words(rng, n, letters="abé"):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    words |= {"hotpre" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(n)}    # a third share their beginning
    words |= {"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) + "ending" for _ in range(n)}
    words |= {w for w in (mutated(rng, w, letters) for w in sorted(words)) if len(w) >= 6}
    return {w: 5 * 6 ** rng.randrange(4) + rng.randrange(3) for w in sorted(words)}


def test_scan_of_a_sorted_list():
    rng = random.Random(1)
    words = sorted(some_words(rng, 60))
    lcps = S.adjacent_lcps(words)
    for w in words:
        for h in range(len(w) + 1):
            got = [words[i] for i in S.one_edit(words, lcps, w, h)]
            assert got == [v for v in words if v[:h] == w[:h] and len(v) >= h and distance(v, w) == 1], (w, h)


def test_blocks_hold_all_partners():
    rng = random.Random(2)
    words = sorted(some_words(rng, 80))
    for size in (1, 2, 7, 50):
        firsts = words[::size]
        for w in words:
            visit = set(S.blocks_to_visit(firsts, w, len(w) // 2))
            need = {i // size for i, v in enumerate(words) if v[:len(w) // 2] == w[:len(w) // 2] and distance(v, w) <= 1}
            assert need <= visit


def test_forms_against_brute_force(spark):
    words = some_words(random.Random(3), 120, "abcéÿ")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute(words)
    assert {tuple(r) for r in S.spelling_forms(df).collect()} == want
    assert {tuple(r) for r in S.spelling_forms(df, block=9).collect()} == want
    assert max(len({r[0], r[1], r[2]}) for r in want) == 3                 # chains of forms occur


def test_texts_against_brute_force(spark):
    rng = random.Random(4)
    pool = list(some_words(rng, 40, "abcdé"))
    rows = [(i, " ".join((rng.choice(pool[:9]) if rng.random() < .6 else rng.choice(pool)).title() for _ in range(80))) for i in range(120)]
    rows += [(7, "Äpfelbaum äpfelbaum ÄPFELBAUM x×y÷zabc ñandúes " * 4), (None, "without an id " * 9), (8, None), (9, ""), (None, None), rows[0]]
    got = S.spelling_variants(spark.createDataFrame([(*r, 1, "w", "f") for r in rows], ROWS + ", n long, word string, form string"))
    assert {tuple(r) for r in got.collect()} == brute(brute_words(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_texts_are_cut_between_runs(spark, monkeypatch):
    text = "abcdefgh, " * 30 + "x" * 500 + " abcdefgi" * 20 + "z" * 90
    monkeypatch.setattr(S, "_PIECE", 37)
    assert "".join(S._pieces(text)) == text
    whole = [r for p in S._pieces(text) for r in re.findall("[a-z]+", p)]
    assert whole == re.findall("[a-z]+", text)


def test_odd_and_empty(spark, odd_docs, no_docs):
    got = {tuple(r) for r in S.spelling_variants(odd_docs).collect()}
    assert got == brute(brute_words([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert S.spelling_variants(no_docs).count() == 0
    assert S.spelling_variants(spark.createDataFrame([(1, "short words only")], ROWS)).count() == 0
