import random

import pytest
from pyspark.sql import functions as F

from kscreen.functions import params
from kscreen.operators import bloom, classify, kmers, report, sampling
from kscreen.operators.classify import reverse_complement

SPIKE = "AGCTTTTCATTCTGACTGCAACGGGCAATATGTCTCTGTGTGGATTAAAA"
DUMMY = "GATTACAT" * 13
K, T = 15, 0.4
READS = "read_id long, seq string"


def walk(seq, known, k, threshold):
    """(contaminated, hits) of one read, step by step."""
    n, hits = len(seq), 0

    def full(s):
        p = [i for i in range(n - k + 1) if s[i : i + k] in known]
        m, r = len(p), sum(1 for i, x in enumerate(p) if i == 0 or x != p[i - 1] + 1)
        value = float(F32((m * k + m + (k - 1) * r) / (k * n + n - k * k))) if n >= k else 0
        return m, m > 0 and k > 1 and value >= float(F32(threshold))

    anchors = sorted({*range(0, n - k + 1, k), n - k}) if n >= k else []
    for a in anchors:
        if seq[a : a + k] in known:
            m, ok = full(seq)
            hits += m
            if ok:
                return True, hits
            break
    back = reverse_complement(seq)
    for a in anchors:
        if back[a : a + k] in known:
            m, ok = full(back)
            hits += m
            if ok:
                return True, hits
    return False, hits


def F32(x):
    import numpy as np

    return np.float32(x)


def screened(spark, rows, ref, k=K, threshold=T, ship=None):
    reads = spark.createDataFrame(rows, READS)
    known = spark.createDataFrame([(x,) for x in ref], "kmer string")
    counted = classify.window_counts(reads, known, k, ["read_id"], ship=ship)
    return classify.verdicts(counted, k, threshold)


def set_of(*seqs, k=K):
    return sorted({s.lower()[i : i + k] for s in seqs for i in range(len(s) - k + 1)})


@pytest.mark.parametrize("ship", [None, 0])
def test_golden_spike(spark, ship):
    rows = [(0, SPIKE.lower())] + [(i, DUMMY.lower()) for i in range(1, 201)]
    out = screened(spark, rows, set_of(SPIKE), ship=ship)
    spike = out.filter("read_id = 0").first()
    assert (spike.fwd_m, spike.fwd_runs, spike.contaminated, spike.hits) == (36, 1, True, 36)
    assert spike.fwd_score == pytest.approx(590 / 575, rel=1e-6)
    r = report.report(out, K).first()
    assert (r.total_read_count, r.contaminated_reads, r.total_hits, r.all_k) == (201, 1, 36, 20850)
    assert r.contamination_rate == pytest.approx(0.004975, abs=1e-6)
    assert r.p_value == pytest.approx(1.513503e-01, rel=1e-6)


@pytest.mark.parametrize("ship", [None, 0])
def test_against_walk(spark, ship):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    genome = dna(600)
    k, rows = 7, []
    for i in range(400):
        s = dna(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 560)
            piece = genome[a : a + rng.randint(5, 40)]
            at = rng.randint(0, len(s))
            s = s[:at] + (piece if rng.random() < 0.5 else reverse_complement(piece)) + s[at:]
        rows.append((i, s))
    rows.append((400, ""))
    known = set_of(genome, k=k)
    got = {r.read_id: (r.contaminated, r.hits) for r in screened(spark, rows, known, k, 0.3, ship).collect()}
    want = {i: walk(s, set(known), k, 0.3) for i, s in rows}
    assert got == want
    assert sum(x[0] for x in want.values()) > 20


def test_empty_tables_and_short_reads(spark):
    assert screened(spark, [], set_of(SPIKE)).count() == 0
    out = screened(spark, [(1, "acgt"), (2, None), (3, "")], []).collect()
    assert [r.contaminated for r in out] == [False] * 3
    empty = report.report(screened(spark, [], []), K).first()
    assert empty.total_read_count == 0 and empty.contamination_rate != empty.contamination_rate and empty.p_value is None


def test_k_of_one_never_classifies(spark):
    assert not screened(spark, [(1, "aaaa")], ["a"], 1, 0.1).first().contaminated


def test_partition_of_input(spark):
    rows = [(i, SPIKE.lower() if i % 3 == 0 else DUMMY.lower()) for i in range(30)]
    out = screened(spark, rows, set_of(SPIKE)).cache()
    both = out.filter("contaminated").select("read_id").unionAll(out.filter("not contaminated").select("read_id"))
    assert both.exceptAll(spark.range(30)).count() == 0 and both.count() == 30


def test_filters_in_one_pass(spark):
    reads = spark.createDataFrame([(1, SPIKE.lower()), (2, DUMMY.lower())], READS)
    ref = spark.createDataFrame([(7, x) for x in set_of(SPIKE)] + [(9, x) for x in set_of(DUMMY)], "item_id long, kmer string")
    out = classify.verdicts(classify.filter_counts(reads, ref, "item_id", K), K, T)
    assert {(r.read_id, r.item_id) for r in out.filter("contaminated").collect()} == {(1, 7), (2, 9)}


def test_tiles_and_kmers(spark):
    df = spark.createDataFrame([(1, "ABCDEFG\nH"), (2, ""), (3, None)], "id long, text string")
    assert [tuple(r) for r in kmers.tiles(df, "text", 4, "id").orderBy("tile_no").collect()] == [(1, 0, "abcd"), (1, 1, "efg\n"), (1, 2, "h")]
    assert kmers.kmers(df, "text", 8, "id").count() == 2
    reads = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdef"), (3, "ab")], READS)
    got = sorted((r.read_id, r.pos, r.kmer) for r in kmers.anchors(reads, 3, "read_id").collect())
    assert got == [(1, 0, "abc"), (1, 3, "def"), (1, 5, "fgh"), (2, 0, "abc"), (2, 3, "def")]


@pytest.mark.parametrize("build,contains", [(bloom.build, bloom.contains), (bloom.build_jenkins, bloom.contains_jenkins)])
def test_bloom_has_no_false_negatives(spark, build, contains):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("acgt") for _ in range(20))
    inside, outside = {word() for _ in range(500)}, {word() for _ in range(2000)}
    sizing = params.sizing(500, 0.005)
    frame = lambda ws: spark.createDataFrame([(w,) for w in sorted(ws)], "kmer string")
    words = build(frame(inside), sizing)
    assert contains(frame(inside), words, sizing).filter("not in_filter").count() == 0
    assert contains(frame(outside - inside), words, sizing).filter("in_filter").count() <= 2 * 0.005 * 2000 + 10


def test_sampling(spark):
    assert [sampling.tenths(x) for x in (0.05, 0.1, 0.25, 0.3, 1)] == [1, 1, 3, 3, 10]
    n = sampling.sample(spark.range(5000), 0.25, F.col("id")).count()
    assert 1300 < n < 1700
