import numpy as np
import pytest
from pyspark.sql import functions as F

from kscreen.functions import params
from kscreen.functions.jenkins import hash36, hash64
from kscreen.functions.significance import p_value
from kscreen.functions.text import ascii_lower, basename, iso_timestamp, last_index, revcomp, stem, strip_newlines

VECTORS = [
    ("agcttttcattctga", 152501029, 16405754881633445127, 20265067783),
    ("agcttttcattctga", 152501717, 345842646292082146, 59868163554),
    ("agcttttcattctgactgca", 152501029, 4013838188942240121, 4526483833),
    ("agcttttcattctgactgca", 152501717, 15112799006783838065, 691672945),
    ("agcttttcattctgactgcaacgggcaat", 152501029, 10508563627462011714, 5410040642),
    ("agcttttcattctgactgcaacgggcaat", 152501717, 14613858623227878012, 58037033596),
]


@pytest.mark.parametrize("key,seed,h64,h36", VECTORS)
def test_hash_vectors(key, seed, h64, h36):
    keys = np.frombuffer(key.encode(), np.uint8)[None]
    assert int(hash64(keys, seed)[0]) == h64
    assert int(hash36(keys, seed)[0]) == h36


def test_sizing():
    assert params.sizing(4_700_000, 0.0005).bits == 67_888_897
    assert params.sizing(4_700_000, 0.0005).n_hashes == 10
    assert (params.sizing(4_700_000, 0.005).bits, params.sizing(4_700_000, 0.005).n_hashes) == (47_522_239, 7)
    assert (params.sizing(1000, 0.005).bits, params.sizing(1000, 0.005).n_hashes) == (10_111, 6)
    assert params.sizing(4_700_000, 0.1).n_hashes == 1
    for capacity, rate in ((0, 0.1), (10, 0.9), (10, 0), (1000, 1e-9)):
        with pytest.raises(ValueError):
            params.sizing(capacity, rate)


def test_prime_quirk():
    assert all(params.passes_as_prime(n) for n in (1, 2, 5, 7, 289, 697, 1681, 7919))
    assert not any(params.passes_as_prime(n) for n in (3, 4, 9, 25, 323, 35))


def test_defaults_agree(spark):
    sizes = [0, 10 * params.MIB - 1, 10 * params.MIB, 60 * params.MIB, 600 * params.MIB]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", params.kmer_size(F.col("n")).alias("k"))
    rows = rows.select("n", "k", params.match_threshold(F.col("k")).alias("t"), params.hit_probability(F.col("k")).alias("p")).collect()
    for r in rows:
        assert r.k == params.default_k(r.n)
        assert r.t == params.default_threshold(r.k)
        assert r.p == params.default_hit_probability(r.k)
    assert [r.k for r in sorted(rows)] == [15, 15, 16, 18, 20]


def test_text(spark):
    df = spark.createDataFrame([("ACGTNacgt-É", "/a/b\\c/x.fastq.gz", "AB\r\nC\n"), (None, None, None)], "s string, p string, l string")
    a, b = df.select(
        ascii_lower(F.col("s")), revcomp(F.col("s")), revcomp(revcomp(F.col("s"))) == F.col("s"), basename(F.col("p")), stem(F.col("p")), strip_newlines(F.col("l")), strip_newlines(F.col("l"), True), last_index(F.col("s"), "a")
    ).collect()
    assert tuple(a) == ("acgtnacgt-É", "É-acgtNACGT", True, "x.fastq.gz", "x.fastq", "AB\rC", "ABC", 6)
    assert tuple(b)[:7] == (None,) * 7


def test_iso_timestamp(spark):
    assert spark.sql("select timestamp'2020-01-02 03:04:05.678' t").select(iso_timestamp(F.col("t"))).first()[0] == "2020-01-02T03:04:05.678+0000"


def test_p_value(spark):
    got = spark.sql("select 36L h, 20850L b union all select 0L, 0L union all select 0L, 5000L").select(p_value(F.col("h"), F.col("b"), F.lit(0.05569))).collect()
    assert got[0][0] == pytest.approx(1.513503e-01, rel=1e-6)
    assert got[1][0] is None
    assert got[2][0] == pytest.approx(0.1396, abs=0.05)
