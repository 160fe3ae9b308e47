"""Names that clash by case or with names used inside, null ids, repeated rows and very long texts, for every operator."""

import public_tokenizers
import pytest

from kscreen.llm import bpe, decontaminate, embeddings, minhash, shards, suffix_dedup, super_kmers, toxicity, warc
from kscreen.llm.token_store import read_crc, write_store

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
NAMES = "DOC_ID long, doc_id long, TEXT string, text string, k1 long, K2 long, _k1 long, spans string, digest string, label int, kept string, n_words int, Score double, ids int, file string"


@pytest.fixture
def docs(spark, prose):
    """Ids with a null and a repeated one, equal rows, a very long text; the other columns hold other things."""
    same = prose(90)
    texts = [(None, same), (None, same), (3, same), (3, prose(40)), (4, None), (5, ""), (6, prose(50)), (7, prose(2000) * 60)]
    rows = [(-1, i, "other", t, 1, 2, 3, "s", "d", 0, "k", 1, 0.5, 9, "f") for i, t in texts]
    return spark.createDataFrame(rows, NAMES), texts


@pytest.fixture
def model(prose):
    rows = [(prose(30) + (" vexmonger grubwort" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    return toxicity.fit(rows)


def ids_of(rows, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in rows)


def test_operators_take_the_named_columns(spark, docs, model):
    df, texts = docs
    bench = spark.createDataFrame([(1, 9, texts[6][1], "other")], "item_id long, ITEM_ID long, text string, Text string")
    want = sorted((i is None, i or 0) for i, _ in texts)
    assert ids_of(read_crc(write_store(df, JSON, 2)).collect()) == want
    assert ids_of(bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()) == want
    assert ids_of(bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()) == want
    found = decontaminate.report(df, bench).collect()
    assert ids_of(found) == want and [r.doc_id for r in found if r.contaminated] == [6]
    assert ids_of(toxicity.score(df, model).collect()) == want
    assert ids_of(minhash.near_duplicates(df).collect(), "id") == want
    for module in (suffix_dedup, super_kmers):
        out = module.remove_repeats(df).collect()
        assert ids_of(out) == want
        assert sorted(r.n_removed > 0 for r in out) == [False] * 4 + [True] * 4  # equal texts, and the long one repeats itself


def test_rows_keep_their_columns(spark, docs, model):
    df, texts = docs
    plain = sorted(map(repr, df.collect()))
    bench = spark.createDataFrame([(1, texts[6][1])], "item_id long, text string")
    for out in (decontaminate.matches(df, bench), toxicity.with_score(df, model), super_kmers.with_kept(df)):
        assert out.columns[: len(df.columns)] == df.columns
        assert sorted(repr(r) for r in out.toDF(*map(str, range(len(out.columns)))).select(*[f"`{i}`" for i in range(len(df.columns))]).toDF(*df.columns).collect()) == plain


@pytest.mark.parametrize("name", ["_found", "_score", "_kept"])
def test_result_names_do_not_overwrite(spark, model, name):
    df = spark.createDataFrame([(1, "a b c", "mine")], f"doc_id long, text string, {name.upper()} string")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    make = {"_found": lambda: decontaminate.matches(df, bench), "_score": lambda: toxicity.with_score(df, model), "_kept": lambda: super_kmers.with_kept(df)}[name]
    with pytest.raises(ValueError):
        make()


def test_vectors_and_pages(spark):
    v = spark.createDataFrame([(-1, 1, [1.0, 0.0], [9.0]), (-1, None, [1.0, 0.0], None), (-1, 1, None, [1.0])], "VEC_ID long, vec_id long, embedding array<double>, Embedding array<double>")
    assert sorted(r.n_links for r in embeddings.near_vectors(v).collect()) == [0, 1, 1]
    p = spark.createDataFrame([(-1, 1, "u", "a", "zz"), (-1, 2, "u", "a", "yy")], "PAGE_ID long, page_id long, url string, html string, HTML string")
    captures = warc.assemble(warc.read_archives(warc.write_archives(p))).collect()
    assert sorted(r.response.type for r in captures) == ["response", "revisit"] and {r.response.payload_digest for r in captures} == {warc.bare_digest(b"a")}


def test_shard_columns(spark, docs):
    from pyspark.sql import functions as F

    df, texts = docs
    plain = df.select(F.col("label").alias("id"), F.col("digest").alias("group"))
    assert shards.lpt_shards(plain, ["group"], F.lit(3), 2, keep={"id": F.col("id")}).count() == len(texts)


def test_unshared_folder_is_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from kscreen.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    there = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError):
        shared_dir(there)
