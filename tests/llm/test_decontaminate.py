from collections import defaultdict

from tabloom.llm import decontaminate as D

ITEMS = [(1, "Alice walks 5 km to the market and then 3 km back home. How many km does she walk in total each day?"),
         (2, "A train with 12 cars leaves the old station at noon and each car carries exactly 40 people to Berlin."),
         (3, "too short"), (4, None), (5, ""), (None, "this item has no id but is long enough to be matched by windows"),
         (6, "seven plain words stand here right now")]
COPY = "Intro words. " + ITEMS[0][1] + " Outro words."
OTHER = "So here it is. Bertram walks 7 miles to the market and then 9 miles back home. How many miles does she walk in total each day? Yes."
TORN = "Alice walks 5 km to the market and then 3 km back home. How many kg does she walk in total each day?"
DOCS = [(1, COPY), (2, COPY.upper()), (3, OTHER), (4, "A clean text about markets, trains and people who walk home each day."), (5, None), (6, ""),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (8, "x " * 50_000 + ITEMS[1][1]), (None, COPY), (1, COPY),
        (9, "and seven plain words stand here right now or so"), (10, "A train with 12 cars leaves the old station")]


def brute(docs, items, size=8, share=0.5, least=5):
    """The definition, window by window and pair by pair; marks are kept as tokens here."""
    def lower(words):
        return [w.lower() for w in words]

    def lines(text):
        """Places between words where a sentence, line or text begins or ends."""
        out, n = {0}, 0
        for t in D._TOKEN.findall(text):
            if t in ".!?\n":
                out.add(n)
            else:
                n += 1
        return out | {n}

    out = set()
    for item, text in items:
        named = D.template(text or "")
        if item is None or not named[0]:
            continue
        n = min(size, len(named[0]))
        windows = len(named[0]) - n + 1
        for doc, body in docs:
            if doc is None:
                continue
            dw, dc, dk = D.template(body or "")
            forms = [(dc.tolist(), dk), (lambda c: (c[1].tolist(), c[2]))(D.template(body or "", False))]
            hits, of = [], {}                       # (way, place in the item, shift, {theirs: ours})
            for way in (0, 1):
                iw, ic, ik = D.template(text, way == 0)
                good = [i for i in range(windows) if len(iw) >= least and 2 * sum(k == D._WORD for k in ik[i:i + n].tolist()) >= n]
                of[way] = len(good)
                for i in good:
                    for codes, kinds in forms:
                        for j in range(len(dw) - n + 1):
                            if codes[j:j + n] == ic[i:i + n].tolist():
                                hits.append((way, i, j - i, list(zip(D._slots(iw, ik, i, n), D._slots(dw, kinds, j, n)))))
                if way == 0:
                    for i in set(range(windows)) - set(good):
                        places = [j for j in range(len(dw) - n + 1) if lower(dw[j:j + n]) == lower(iw[i:i + n])]
                        if len(iw) < least:
                            places = [j for j in places if {j, j + n} <= lines(body)]
                        hits += [(2, i, None, []) for _ in places[:1]]
            values = defaultdict(set)
            for way, i, shift, slots in hits:
                for theirs, ours in slots:
                    values[shift, theirs].add(ours)
            kept = [(way, i) for way, i, shift, slots in hits if all(len(values[shift, t]) == 1 for t, _ in slots)]
            found = [(len({i for _, i in kept}), windows)] + [(len({i for w, i in kept if w == way}), of[way]) for way in (0, 1) if of[way] >= share * windows]
            best = max(found, key=lambda f: (f[0] / max(f[1], 1), f[1]))
            if kept and best[0] >= share * best[1]:
                out.add((doc, item, *best))
    return out


def _run(spark, docs, items):
    d = spark.createDataFrame([(*x, "h", 1) for x in docs], "doc_id long, text string, hash string, size int")
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, matched int")
    return d, i


def test_matches_brute_force(spark):
    d, i = _run(spark, DOCS, ITEMS)
    got = {tuple(r) for r in D.contaminated(d, i).collect()}
    assert got == brute(DOCS, ITEMS)
    assert {(a, b) for a, b, _, _ in got} >= {(1, 1), (2, 1), (3, 1), (8, 2), (9, 6)} and not {a for a, *_ in got} & {4, 5, 6, 7, 10}


def test_inconsistent_slots_are_dropped(spark):
    item = [(1, "Bob has 5 apples and gives 5 apples to Eve so that 5 apples are left for Bob and none for Eve today")]
    same = (1, "Tom has 8 apples and gives 8 apples to Ann so that 8 apples are left for Tom and none for Ann today")
    torn = (2, "Tom has 8 apples and gives 3 apples to Ann so that 4 apples are left for Jim and none for Sue today")
    got = D.contaminated(*_run(spark, [same, torn], item)).collect()
    assert [r.doc_id for r in got] == [1] and brute([same, torn], item) == {tuple(r) for r in got}


def test_clean_documents_stay(spark):
    numbers = " ".join(str(i) for i in range(11, 51))
    items = [(1, "Yes."), (2, "The year"), (3, f"Add these numbers now: {numbers}")]
    docs = [(1, "He nodded and said yes to the offer of the old man."), (2, "a quiet story about the year my uncle came home"),
            (3, "add these numbers now: 5 6 7 8"), (4, "Did she come? Yes. She did."), (5, "2021\nthe year\n"), (6, f"so add these numbers now: {numbers} and stop")]
    got = {tuple(r) for r in D.contaminated(*_run(spark, docs, items)).collect()}
    assert got == brute(docs, items) and {(d, i) for d, i, *_ in got} == {(4, 1), (5, 2), (6, 3)}


def test_random_texts_against_brute_force(spark):
    import random
    rng = random.Random(9)
    pool = ["the", "old", "Anna", "Berlin", "12", "7", "km", "kg", "walks", "home", "in", ".", "and", "Yes", "m", "?"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 6, 9, 14, 20]))) for i in range(25)]
    docs = []
    for i in range(120):
        words = rng.choice(items)[1].split()
        if rng.random() < .6:
            words = [rng.choice(["12", "7", "40"]) if w.isdigit() and rng.random() < .5 else rng.choice(["Anna", "Berlin"]) if w in ("Anna", "Berlin") else w for w in words]
        body = " ".join(words)
        docs.append((i, rng.choice(["", text(3) + " . ", text(5) + " "]) + (body.upper() if i % 7 == 0 else body.title() if i % 5 == 0 else body) + rng.choice(["", " . " + text(3), " " + text(4)])))
    got = {tuple(r) for r in D.contaminated(*_run(spark, docs, items)).collect()}
    assert got == brute(docs, items)


def test_stage_and_empty_tables(spark):
    d, i = _run(spark, DOCS, ITEMS)
    kept = D.drop_contaminated(d, i)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "4", "5", "6", "7", "None"]
    assert D.contaminated(d.where("false"), i).count() == 0
    assert D.contaminated(d, i.where("false")).count() == 0 and D.drop_contaminated(d, i.where("false")).count() == len(DOCS)


def test_hot_passage(spark):
    docs = [(n, f"own words {n} " + (ITEMS[0][1] if n % 3 == 0 else "nothing to see in this one")) for n in range(900)]
    got = D.contaminated(*_run(spark, docs, ITEMS)).collect()
    assert {r.doc_id for r in got} == {n for n in range(900) if n % 3 == 0}


def test_heavy_windows_and_short_items(spark):
    items = [(1, "Add 12 kg, 3 kg, 45 kg and 7 kg."), (2, "Paris Rome 3"), (3, "please count these plain words one by one 4 5 6 7 8 9 10 11 12")]
    docs = [(1, "He says: add 12 kg, 3 kg, 45 kg and 7 kg. Then rest."), (2, "add 12 kg, 3 kg, 46 kg and 8 kg."), (3, "Cities first.\nPARIS, rome 3\nand more"),
            (4, "from Paris to Rome 3 times"), (5, "so please count these plain words one by one 4 5 6 7 8 9 10 11 12"),
            (6, "so please count these plain words one by one 9 8 6 1 3 2 14 13 12")]
    got = {(r.doc_id, r.item_id): (r.matched, r.of) for r in D.contaminated(*_run(spark, docs, items)).collect()}
    assert got == {(1, 1): (3, 3), (3, 2): (1, 1), (5, 3): (10, 10), (6, 3): (5, 5)}
    assert {(a, b, *v) for (a, b), v in got.items()} == brute(docs, items)
    assert [r.doc_id for r in D.drop_contaminated(*_run(spark, docs, items)).orderBy("doc_id").collect()] == [2, 4]


def test_copies_after_a_colon_and_in_title_case(spark):
    items = [(1, "What is the capital of France?"), (2, ITEMS[0][1])]
    docs = [(1, "Q: What is the capital of France? A: Paris"), (2, "so " + ITEMS[0][1].title()), (3, "Q: Who is the mayor of France?")]
    got = {(r.doc_id, r.item_id): (r.matched, r.of) for r in D.contaminated(*_run(spark, docs, items)).collect()}
    n = len(D.template(ITEMS[0][1])[0]) - 7
    assert {(a, b, *v) for (a, b), v in got.items()} == brute(docs, items)
    assert got == {(1, 1): (1, 1), (2, 2): (n, n)}
    for _, text in docs + DOCS:
        words, codes, kind = D.template(text or "")
        theirs = D.template(text or "", names=False)
        mine = D.unnamed(words, codes, kind)
        assert mine[0].tolist() == theirs[1].tolist() and mine[1].tolist() == theirs[2].tolist()


def test_only_windows_with_a_torn_slot_are_dropped(spark):
    items = [(1, "there were 12 birds on one side of the wide river and 40 birds on the other side"),
             (2, "after 3 apples fell from the old tree in the garden behind our house the boys went home to eat and then 3 of them slept")]
    docs = [(1, "there were 20 birds on one side of the wide river and 20 birds on the other side"),
            (2, "after 4 apples fell from the old tree in the garden behind our house the boys went home to eat and then 5 of them slept")]
    got = {(r.doc_id, r.item_id): (r.matched, r.of) for r in D.contaminated(*_run(spark, docs, items)).collect()}
    assert {(a, b, *v) for (a, b), v in got.items()} == brute(docs, items)
    words = D.template(items[1][1])[0]
    free = sum("3" not in words[i:i + 8] for i in range(len(words) - 7))
    assert got == {(1, 1): (11, 11), (2, 2): (free, len(words) - 7)}
