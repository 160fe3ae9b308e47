import base64
import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from kscreen.llm import decontaminate, minhash, queries, super_kmers, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def kept_words(texts, window=super_kmers.WINDOW):
    """Each text without its repeated windows, by a dictionary of all windows."""
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for t, d in zip(texts, docs, strict=True):
        gone = {i + j for i in range(len(d) - window + 1) if seen[tuple(d[i : i + window])] > 1 for j in range(window)}
        out.append(b" ".join(w for i, w in enumerate(d) if i not in gone).decode() if gone else t)
    return out


def test_stages_against_brute_force(spark):
    """Ids, cut texts and tokens of the whole pipeline, each stage by a plain way of its own."""
    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(toxicity.training_rows(docs, queries.table(spark, SF, "labels")))
    left = [i for i in sorted(rows) if model.score(rows[i]) < 0.3]
    near = minhash.brute_force(left, [rows[i] for i in left])
    left = [i for i in left if near[i][2]]
    cut = dict(zip(left, kept_words([rows[i] for i in left]), strict=True))
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    matcher = decontaminate.Matcher([(i, decontaminate.normal(t)) for i, t in items])
    clean = [i for i in left if not matcher.match(decontaminate.normal(cut[i]))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in clean:
        ids = plain.encode_ordinary(cut[i] or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((cut[i] or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(rows) and any(cut[i] != rows[i] for i in clean)


def test_stages_on_odd_tables(spark, prose):
    """Nulls in any column, empty, very long and repeated texts and further columns: no stage fails, and those but the last keep COLUMNS."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, _k1 long, _found string, _score double, label int"
    rows = [(None, None), (None, ""), (1, prose(90)), (1, prose(2000) * 50), (2, prose(60)), (2, "a b"), (None, prose(80))]
    odd = spark.createDataFrame([(i, t, None, None, None, "x", 1, "f", 0.1, 2) for i, t in rows * 2], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != "bpe":
                assert tuple(out.columns) == P.COLUMNS, name
            if name in ("substring_dedup", "bpe"):
                assert len(got) == docs.count()
            assert docs.count() == 0 or len(got) >= 3


def test_columns_are_kept(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns, name


def test_registered():
    import __spark_entry__ as entry

    found = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert found == {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()


def test_one_row_stays_of_each_near_group(spark, prose):
    a, b = prose(200), prose(200)
    rows = [(None, a), (None, a + " more"), (None, a + " words"), (7, b), (7, b + " more"), (9, b + " words"), (9, prose(200)), (5, ""), (5, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, SF).collect()]
    assert sum((t or "").startswith(a) for _, t in kept) == 1
    assert [i for i, t in kept if (t or "").startswith(b)] == [7]
    assert rows[6] in kept and {(5, ""), (5, None), (None, " ")} <= set(kept)
    assert len(kept) == 6
