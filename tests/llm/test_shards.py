import zlib

from pyspark.sql import functions as F

from kscreen.llm.shards import lpt_plan, lpt_shards, write_shards


def placed(df, n=5):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return lpt_shards(df, ["text"], size, n, keep={"doc_id": F.col("doc_id"), "text": F.col("text")})


def test_plan():
    assert lpt_plan([("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert lpt_plan([], 3) == {}


def test_groups_slots_and_balance(spark, docs_of, prose, tmp_path):
    texts = [prose(i % 90 + 1) for i in range(400)] + ["copy of one text"] * 150 + [None, "", None]
    out = placed(docs_of(texts))
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    home, load, slots = {}, {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
        assert home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(load) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 40
    write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(texts)


def test_fewer_groups_than_shards_and_none(spark, docs_of):
    assert placed(docs_of([])).count() == 0
    assert {r.slot for r in placed(docs_of(["a", "b"]), 40).collect()} == {0}
    assert len({r.shard for r in placed(docs_of(["same"] * 9), 4).collect()}) == 1


def test_crc_is_of_utf8(spark):
    got = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()[0]
    assert got == zlib.crc32("é".encode())


def test_plan_against_brute_force(spark, docs_of, prose, monkeypatch):
    """With a grain of one byte every group goes through the heap: the loads are those of plain LPT over all groups."""
    from kscreen.llm import shards

    monkeypatch.setattr(shards, "GRAINS", 10**9)
    texts = [prose(i % 40 + 1) for i in range(200)] + ["one text"] * 60 + [None, ""]
    rows = placed(docs_of(texts), 7).collect()
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    loads = [0] * 7
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = [0] * 7
    for r in rows:
        got[r.shard] += r.size
    assert sorted(got) == sorted(loads)


def test_hot_group_and_long_text(spark):
    rows = [(None, "hot")] * 3000 + [(i, f"text {i}") for i in range(1000)] + [(5000, "x" * 10_000_000)]
    out = placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), 4).collect()
    assert len(out) == len(rows) and len({r.shard for r in out if r.text == "hot"}) == 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
