from conftest_llm import ODD_TEXTS

from kscreen.llm import decontaminate as D


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("qz")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("qz"))
    return "".join(s)


def test_distance(rng):
    for _ in range(200):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 30)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
        row = list(range(len(a) + 1))
        best = row[-1]
        for c in t:
            last, row[0] = row[0], 0
            for i, x in enumerate(a, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
            best = min(best, row[-1])
        assert D.distance(a, t) == best


def test_finds_items_within_budget_only(spark, docs_of, prose, rng):
    items = [(i, prose(12 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "short one"), (None, prose(20))]
    texts = list(ODD_TEXTS)
    for i, item in items[:12]:
        for n in (0, D.budget(D.normal(item)), D.budget(D.normal(item)) + 4):
            texts.append(f"{prose(20)}\n{edited(rng, item, n).upper() if i % 2 else edited(rng, item, n)}  {prose(9)}")
    texts += [prose(60), "a short   ONE here", items[-1][1], items[3][1] + " " + items[4][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.report(docs_of(texts), bench).collect()}
    for i, t in enumerate(texts):
        want = D.brute_force(t, items)
        assert (got[i].item_ids, got[i].n_items, got[i].contaminated) == (sorted((k for k, _ in want), key=lambda k: (k is None, k)), len(want), bool(want)), t
        assert got[i].min_distance == min((d for _, d in want), default=None)


def test_blocks_and_empty_benchmark(spark, docs_of, prose, monkeypatch):
    items = [(i, prose(15)) for i in range(6)]
    docs = docs_of([t for _, t in items] + ["clean"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = D.report(docs, bench).collect()
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert sorted(D.report(docs, bench).collect()) == sorted(whole)
    assert D.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert D.report(docs.limit(0), bench).count() == 0
