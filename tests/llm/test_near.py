import math
import random

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from kscreen.llm import embeddings, minhash
from kscreen.llm.components import components


def near_copies(prose, rng):
    texts = list(ODD_TEXTS) + ["one two three", "ONE two  three", "three two one"]
    for _ in range(12):
        base = prose(rng.randint(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    return texts + [texts[20]] * 6


@pytest.mark.parametrize("block", [512, 2])
def test_minhash(spark, docs_of, prose, rng, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(prose, rng)
    found = minhash.near_duplicates(docs_of(texts)).collect()
    got = {r.id: (r.n_shingles, r.component_id, r.id == r.component_id) for r in found}
    assert got == minhash.brute_force(list(range(len(texts))), texts)
    assert len(found) == len(texts)


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        error = []
        for _ in range(30):
            both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(1000 * share), int(500 * (1 - share)), int(500 * (1 - share))))
            x, y = (minhash.packed(minhash.minima(np.concatenate([both, z]))) for z in (a, b))
            error.append(float(minhash.estimate(x, y)) - share)
        assert abs(np.mean(error)) < 0.03


def test_minhash_nothing_and_null_ids(spark, docs_of, prose):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    text = prose(30)
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (None, "")], "doc_id long, text string")
    assert sorted((r.id or -1, r.component_id or -1) for r in minhash.near_duplicates(df).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_minhash_signatures_stay(spark, docs_of, prose, rng, monkeypatch):
    """Signatures of texts without a near copy are not shuffled to look up those of the others (before: all were)."""
    texts = [prose(40) for _ in range(1500)]
    for t in texts[:3]:  # a class with two partners each, which leaves its bucket open
        texts += [t + " more", t + " other words"]
    bytes_of = {}

    def store(df, tag, plain=minhash.store):
        before = shuffled(spark)
        path = plain(df, tag)
        bytes_of[tag] = shuffled(spark) - before
        return path

    monkeypatch.setattr(minhash, "store", store)
    docs = docs_of(texts)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        found = minhash.near_duplicates(docs)
        assert found.filter("id <> component_id").count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert bytes_of["open-sets"] < bytes_of["classes"] / 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    got = {r.v: r.label for r in components(spark.createDataFrame(chain + star + [(7, 3), (200, 200)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def joined(spark):
    """Rows that all joins so far have made."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    status, total = spark._jsparkSession.sharedState().statusStore(), 0
    for e in range(status.executionsCount()):
        i = status.executionsList().apply(e).executionId()
        values, nodes = status.executionMetrics(i), status.planGraph(i).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            metrics = node.metrics()
            made = [metrics.apply(m) for m in range(metrics.size()) if "Join" in node.name()]
            made = [values.get(m.accumulatorId()) for m in made if m.name() == "number of output rows"]
            total += sum(int(x.get().replace(",", "")) for x in made if x.isDefined())
    return total


def test_components_join_a_link_once(spark, rng):
    """Links inside a component are joined once for each end, not in every round (before: 53,106 rows for 8,451 links)."""
    links = {(min(p), max(p)) for p in ((rng.randrange(400), rng.randrange(400)) for _ in range(9000)) if p[0] != p[1]}
    links = spark.createDataFrame(sorted(links), "a long, b long").localCheckpoint()
    n, before = links.count(), joined(spark)
    assert {r.label for r in components(links).collect()} == {0}
    assert joined(spark) - before < 3 * n


def test_components_of_any_links(spark, rng):
    """Chains, trees and rings whose least vertices lie anywhere, against a walk."""
    for n in (30, 300):
        names = rng.sample(range(10 * n), n)
        pairs = [(names[i], names[rng.randrange(max(0, i - 4), i)]) for i in range(1, n) if rng.random() < 0.9]
        pairs += [(names[rng.randrange(n)],) * 2, pairs[0], pairs[1][::-1]]
        want = {v: v for p in pairs if p[0] != p[1] for v in p}
        for _ in range(n):
            for a, b in pairs:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        links = spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in pairs], "a string, b string")
        assert {int(r.v): int(r.label) for r in components(links).collect()} == want


def vectors(n=150, dim=24):
    rng = random.Random(3)
    unit = lambda: [rng.gauss(0, 1) for _ in range(dim)]
    out = [None, [], [0.0] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [1e-200] * dim, [1e200] * dim]
    for _ in range(n // 10):
        base = unit()
        out += [base, list(base), [3 * x for x in base]]
        for _ in range(7):
            out.append([x + rng.gauss(0, 0.3) for x in base])
    return out


@pytest.mark.parametrize("chunk", [4096, 7])
def test_embeddings(spark, chunk, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    vs = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int, digest string")
    found = embeddings.near_vectors(df).collect()
    assert {r.id: (r.n_links, r.component_id, r.id == r.component_id) for r in found} == embeddings.brute_force(list(range(len(vs))), vs)
    assert len(found) == len(vs) and sum(r.n_links > 0 for r in found) > 60


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    jvm, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_embeddings_do_not_travel(spark, monkeypatch):
    """Comparisons grow with the square of the rows, what is shuffled does not (before: each vector once a cell)."""
    monkeypatch.setattr(embeddings, "CHUNK", 64)
    x = np.random.default_rng(5).standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").coalesce(4).localCheckpoint()
    before = shuffled(spark)
    assert embeddings.near_vectors(df).count() == 3000
    assert shuffled(spark) - before < 4 * x.nbytes


def test_embeddings_equal_in_many_tasks(spark, monkeypatch):
    """Each task stores its own copy of a vector; counts are those of rows. Single and double precision meet."""
    monkeypatch.setattr(embeddings, "CHUNK", 5)
    monkeypatch.setattr(embeddings, "SHARE", 3)
    vs = vectors(60) * 3
    vs += [[float(np.float32(x)) for x in v] for v in vs[10:40]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>").repartition(7)
    got = {r.id: (r.n_links, r.component_id, r.id == r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == embeddings.brute_force(list(range(len(vs))), vs)


def test_embeddings_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0
    one = spark.createDataFrame([(None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert [(r.n_links, r.component_id) for r in embeddings.near_vectors(one).orderBy(F.col("id")).collect()] == [(0, None), (0, None)]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_on_a_whole_table(spark):
    """All links of a table, against all pairs of whole sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = minhash.brute_force([r.doc_id for r in rows], [r.text for r in rows])
    got = {r.id: (r.n_shingles, r.component_id, r.id == r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want and sum(not kept for _, _, kept in want.values()) > 50
