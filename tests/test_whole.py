"""Queries over whole inputs, against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from kscreen.functions import params
from kscreen.operators import bloom
from kscreen.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents that meet the benchmark only after their first tile."""
    d = str(tmp_path_factory.mktemp("whole"))
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(i, text(60)) for i in range(6)]
    docs = [(i, text(150) + items[i % 6][1][: 20 + i] + text(200)) for i in range(40)] + [(40, ""), (41, None), (42, "short")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, docs, items


def windows(s, k=queries.K):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def membership(docs, items, sizing):
    """(in_filter, in_set) -> k-mers, step by step."""
    places = lambda x: [int(hashlib.md5(f"{x}:{i}".encode()).hexdigest()[:9], 16) % sizing.bits for i in range(sizing.n_hashes)]
    known = {w for _, s in items for w in windows(s)}
    bits = {p for x in known for p in places(x)}
    asked = {w for _, s in docs for a in range(0, len(s or ""), queries.TILE) for w in windows(s[a : a + queries.TILE])}
    return Counter((all(p in bits for p in places(x)), x in known) for x in asked)


def test_membership_asks_all_tiles(spark, tables):
    d, docs, items = tables
    got = {(r.in_filter, r.in_set): r.n for r in queries.bloom_membership(spark, d).collect()}
    assert got == membership(docs, items, params.sizing(20_000, 0.005))
    assert got[True, True] > 100


def test_filter_joined_or_shipped(spark, tables, monkeypatch):
    d, docs, items = tables
    sizing = params.sizing(100, 0.005)
    known = queries.reference(spark, d)
    asked = queries.read_windows(spark, d).select("kmer").distinct()
    shipped = bloom.contains(asked, bloom.build(known, sizing), sizing).collect()
    monkeypatch.setattr(bloom, "SHIP_BITS", 0)
    assert sorted(shipped) == sorted(bloom.contains(asked, bloom.build(known, sizing), sizing).collect())
    want = membership(docs, items, sizing)
    assert sum(r.in_filter for r in shipped) == want[True, True] + want[True, False] > want[True, True]


def test_items_beyond_ship(spark, tables, monkeypatch):
    d, docs, _ = tables
    from kscreen.functions.text import revcomp
    from kscreen.operators import classify

    rows, known = queries.reads(spark, d), queries.reference(spark, d, "item_id")
    rows = rows.unionByName(rows.select((-rows.doc_id - 1).alias("doc_id"), "tile_no", revcomp(rows.seq).alias("seq")))
    order = lambda df: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in df.collect())
    for both in (True, False):
        counted = [classify.filter_counts(rows, known, "item_id", queries.K, both=both, key=queries.KEY, ship=ship) for ship in (None, 0)]
        assert counted[0].columns == counted[1].columns
        assert len(order(counted[0])) > 20 and order(counted[0]) == order(counted[1])
    shipped, streamed = queries.per_item_report(spark, d).collect(), queries.stream_report(spark, d).collect()
    assert sum(r.total_hits for r in shipped) > 100
    monkeypatch.setattr(classify, "SHIP_KMERS", 10)
    assert sorted(queries.per_item_report(spark, d).collect()) == sorted(shipped)
    assert queries.stream_report(spark, d).collect() == streamed


def test_filter_holds_a_large_benchmark(spark, tmp_path):
    d, rng = str(tmp_path), random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items, docs = [(i, text(3000)) for i in range(20)], [(i, text(2000)) for i in range(10)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    n = len({w for _, s in items for w in windows(s)})
    info = queries.filter_info(spark, d).first()
    assert info.capacity == info.inserts == n > 20_000
    sizing = params.sizing(n, 0.005)
    for words in (queries.bloom_words(spark, d), queries.bloom_jenkins(spark, d)):
        assert 0.4 < sum((r.word & (1 << 64) - 1).bit_count() for r in words.collect()) / sizing.bits < 0.55
    got = {(r.in_filter, r.in_set): r.n for r in queries.bloom_membership(spark, d).collect()}
    assert got == membership(docs, items, sizing)
    assert got.get((True, False), 0) < 0.02 * got[False, False]
