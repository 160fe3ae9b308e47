import math

import pyarrow as pa
import pytest
from conftest_llm import ODD_TEXTS

from kscreen.llm import toxicity as X

BAD = ["blorgface", "snarkling", "vexmonger", "grubwort"]


@pytest.fixture
def labelled(prose, rng):
    rows = []
    for i in range(240):
        words = prose(rng.randint(5, 120)).split()
        y = int(i % 4 == 0)
        for _ in range(rng.randint(1, 3) * y):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((" ".join(words), y))
    return rows


def test_learns_and_holds_out(labelled):
    model = X.fit(labelled[:180])
    calls = [(model.score(t) >= 0.3, y == 1) for t, y in labelled[180:]]
    assert sum(a and b for a, b in calls) >= 14
    assert sum(a and not b for a, b in calls) <= 1
    assert model.score("") == model.score(None) < 0.3


def test_all_rows_and_labels_only_from_training(spark, docs_of, labelled):
    import zlib

    texts = [t for t, _ in labelled] + ODD_TEXTS
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(labelled)] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    rows = X.training_rows(docs, labels)
    used = {r[0] for r in rows}
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, t in enumerate(texts[: len(labelled)]) if t in used and texts.count(t) == 1)
    model = X.fit(rows)
    out = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert len(out) == len(texts) and all(0 <= s <= 1 for s in out.values())
    assert {r.doc_id: r._score for r in X.with_score(docs, model).collect()} == out
    again = X.with_score(X.with_score(docs, model), model, out_col="twice").collect()
    assert all(r.twice == r._score for r in again)
    with pytest.raises(ValueError):
        X.with_score(X.with_score(docs, model), model)


def test_repeated_ids_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted(X.training_rows(docs, labels)) == [("a", 1, 1.0), ("c", 0, 1.0)]


def test_against_plain_evaluation(labelled):
    """The vectorised features equal a walk over single windows, compressed one by one in every pair."""
    model = X.fit(labelled[:120])
    d = model.dictionaries
    pairs = d._open()
    for text, _ in labelled[120:140] + [("", 0), ("Odd  WORD, ... \u3000 x", 0), ("word " * 5000, 0)]:
        counts = dict.fromkeys([*(("least", t) for t in X.LEAST), *(("middle", t) for t in X.MIDDLE)], 0)
        for w in X.windows(text):
            window = f" {w} ".encode() + d.shared[-X.TAIL_BYTES :]
            saved = sorted(len(b.compress(window)) - len(a.compress(window)) for a, b in pairs)
            for kind, t in counts:
                counts[kind, t] += (saved[0] if kind == "least" else saved[1]) >= t
        want = [math.log1p(c) for c in counts.values()] + [max(0.0, math.log(max(1, len(X.windows(text))) / X.LONG))]
        assert d.features(pa.array([text]))[0].tolist() == pytest.approx(want)


def test_no_labels(spark, docs_of):
    model = X.fit(X.training_rows(docs_of(["a b c"]), spark.createDataFrame([], "doc_id long, toxic int")))
    assert [r.score < 0.3 for r in X.score(docs_of(["a b c", None]), model).collect()] == [True, True]
    assert X.score(docs_of([]), model).count() == 0


def test_one_class_only():
    assert 0 <= X.fit([("some ordinary words", 0)] * 5).score("other words") < 0.3


@pytest.mark.xfail(reason="a word of two or three letters costs hardly more than a match: its distance is below every threshold")
@pytest.mark.parametrize("bad", [["zqx", "qzk", "xjz"], ["zq", "qx"], ["żół", "злы"]])
def test_short_words_are_evidence(prose, rng, bad):
    rows = [(prose(60) + " " + " ".join(rng.choices(bad, k=3)) * (i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    model = X.fit(rows[:180])
    assert all((model.score(t) >= 0.3) == (y == 1) for t, y in rows[180:])
