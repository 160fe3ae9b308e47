import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest_llm import ODD_TEXTS

from kscreen.llm import bpe
from kscreen.llm import token_store
from kscreen.llm.token_store import Levels, TokenFile, pack_levels, read_crc, read_store, write_file, write_store
from kscreen.llm.units import UnitCache, Units

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(rng, n):
    return ["".join(rng.choice("ab cdé \n\t'sre  l0.,! 　x") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_units_join_back(rng):
    texts = strange(rng, 500)
    units = Units(pa.array(["", *texts, "", "left"]).slice(1, 501))
    data, ends = units.joined(units.distinct.to_pylist())
    assert [bytes(data[a:b]).decode() for a, b in zip(ends.tolist(), ends[1:].tolist())] == [*texts, ""]


def test_replay_equals_greedy_merging(rng):
    replay = bpe.MergeReplay(bpe.load_ranks(RANKS))
    words = [s.encode() for s in strange(rng, 300) if s] + [b"a" * n for n in range(1, 40)] + [b"\xff\xfe", b"thththth"]
    assert replay.replay(words) == [replay.alone(w) for w in words]
    assert replay.replay([]) == []


def test_encode_as_tiktoken_does(spark, docs_of, rng, tiktoken_encoding):
    texts = ODD_TEXTS + strange(rng, 200)
    df = docs_of(texts)
    out = {r.doc_id: r.ids for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert out == {i: tiktoken_encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    digests = {r.doc_id: r for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    decoded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded} == {i: t or "" for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert digests[i].n_tokens == len(out[i])
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, out[i])).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_cache_turns_over(rng):
    calls = []
    cache = UnitCache(lambda x: calls.append(len(x)) or list(x), limit=20)
    for t in strange(rng, 400):
        data, ends = cache.encode(pa.array([t]))
        assert bytes(data or b"") == t.encode() and ends.tolist() == [0, len(t.encode())]
    assert len(cache.known) <= 20 + 60 and len(calls) > 5


def test_decode_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([50_000_0],)], "ids array<int>"), RANKS).collect()


@pytest.mark.parametrize("ids", [[], [0], [255], [256], [65_536], list(range(0, 300_000, 37)), [2] * 5000])
def test_token_file(tmp_path, ids):
    levels = Levels()
    for i in range(0, len(ids), 999):
        levels.add(np.array(ids[i : i + 999], np.uint32))
    write_file(str(tmp_path / "f"), pa.array([None, 5], pa.int64()), np.array([len(ids) // 2, len(ids)]), levels)
    f = TokenFile(str(tmp_path / "f"))
    assert f.ids().tolist() == ids
    for i in {0, 1, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert f.token(i) == ids[i]
    with pytest.raises(IndexError):
        f.token(len(ids))
    assert f.document(0).tolist() == ids[: len(ids) // 2] and f.document(1).tolist() == ids[len(ids) // 2 :]
    for a, b in ((0, 0), (1, 3), (len(ids) // 3, len(ids)), (len(ids), len(ids))):
        assert f.slice(min(a, len(ids)), min(b, len(ids))).tolist() == ids[a:b]
    assert len(pack_levels(np.array(ids, np.uint32))) <= 3


SPECIAL = ["<|endoftext|> a", "hello <|endoftext|> there", "x<|endoftext|>y  <|endoftext|>", "<|endoftext|", "a<|b|>c's don't <|endoftext|><|endoftext|>."]


@pytest.mark.parametrize("file_ids,run", [(8_000_000, 4 << 20), (50, 200)])
def test_store(spark, docs_of, rng, file_ids, run, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "FILE_IDS", file_ids)
    monkeypatch.setattr(token_store, "RUN_BYTES", run)
    monkeypatch.setattr(token_store, "READ_IDS", run)
    texts = ODD_TEXTS + strange(rng, 100) + SPECIAL
    df = docs_of(texts).unionByName(docs_of([None]).selectExpr("cast(null as long) doc_id", "'last' text", "TEXT2", "spans", "k1", "_text"))
    t = Tokenizer.from_file(JSON)
    manifest = write_store(df, JSON, 2)
    rows = read_crc(manifest).collect()
    at = 0
    for doc_id, text in [(None, "last"), *enumerate(texts)]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        r = next(r for r in rows if r.doc_id == doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)
    assert len(rows) == len(texts) + 1
    assert sorted((r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read_store(manifest).collect()) == sorted((r.start, r.ids_crc32) for r in rows)
    assert read_store(write_store(docs_of([]), JSON, 2)).count() == 0


def test_special_tokens_are_the_librarys(spark, docs_of):
    ids = {r.doc_id: r.ids for r in read_store(write_store(docs_of(SPECIAL), JSON, 2)).collect()}
    assert ids[1] == [31373, 220, 50256, 612, 2]


def test_rows_of_one_id(spark, prose):
    texts = [prose(i % 7) for i in range(300)]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    rows = read_store(write_store(df.repartition(6), JSON, 2)).orderBy("start").collect()
    assert len(rows) == 300 and [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()


def test_very_long_text(spark, prose, tiktoken_encoding):
    texts = [prose(1000) * 1000, "ab" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert [got[i].decoded_sha256 for i in (0, 1)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert got[0].n_tokens == len(tiktoken_encoding.encode_ordinary(texts[0]))
    rows = read_crc(write_store(df.limit(1), JSON, 2)).collect()
    assert rows[0].n_tokens == got[0].n_tokens + 1
