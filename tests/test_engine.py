"""Kernels, lists of references and filters, long sequences, file heads and settings."""

import io
import random

import pytest
from pyspark.sql import functions as F

from kscreen.__main__ import main
from kscreen.functions import params
from kscreen.functions.text import ascii_lower
from kscreen.operators import bloom, classify, compare, kmers
from kscreen.plans import screen
from kscreen.sources import fastx, filters, tables
from kscreen.sources.config import settings

K = 15


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Two references, two samples that hold parts of them on either strand, and their reads."""
    d, rng = tmp_path_factory.mktemp("engine"), random.Random(4)
    refs = [dna(rng, 3000) for _ in range(2)]
    for i, g in enumerate(refs):
        (d / f"r{i}.fasta").write_text(f">g{i}\n" + "\n".join(g[j : j + 70] for j in range(0, len(g), 70)) + "\n")
    turn = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(120):
        g = refs[i % 2]
        at = rng.randrange(2800)
        part = g[at : at + 20 + i % 60]
        reads.append((dna(rng, i % 30) + (part[::-1].translate(turn) if i % 3 == 0 else part) + dna(rng, 20)) if i % 4 else dna(rng, i))
    for s in range(2):
        own = reads[s * 60 : s * 60 + 60]
        (d / f"s{s}.fastq").write_text("".join(f"@q{i}\n{x}\n+\n{'I' * len(x)}\n" for i, x in enumerate(own)))
    return d, refs, reads


def test_windows_of_any_length(spark):
    rng = random.Random(2)
    texts = [None, ""] + ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 14, 15, 255, 256, 257, 270, 271, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for k in (1, K, 300):
        got = sorted((r.i, r.pos, r.kmer) for r in kmers.windows(df, F.col("t"), k, "i").collect())
        assert got == [(i, p, t[p : p + k]) for i, t in enumerate(texts) for p in range(len(t or "") - k + 1)]


def test_long_sequence(spark, tmp_path):
    rng = random.Random(3)
    g = dna(rng, 1_000_000)
    (tmp_path / "g.fasta").write_text(">g\n" + "\n".join(g[i : i + 60] for i in range(0, len(g), 60)) + "\n")
    known = screen.reference_kmers(spark, str(tmp_path / "g.fasta"), K)
    low = g.lower()
    assert known.count() == len({low[i : i + K] for i in range(len(low) - K + 1)})


def test_text_before_the_first_record_is_skipped(spark, tmp_path):
    texts = {"a": "junk line\nACGT\n>h\nAC\nGT\n>i\nTT\n", "b": ">only\nGG\n", "c": "no record at all\n", "d": "", "e": ">x\n>y\nA\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.fasta").write_text(text)
    got = sorted((r.file[-7:-6], r.header, r.seq) for r in fastx.read(spark, str(tmp_path)).collect())
    assert got == [("a", "h", "ACGT"), ("a", "i", "TT"), ("b", "only", "GG"), ("e", "x", ""), ("e", "y", "A")]


def test_split_files_keep_their_heads_out(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "x.fasta").write_text("head\nAC\n" + "".join(f">h{i}\n{dna(rng, 200)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
        assert sorted(r.header for r in fastx.read(spark, str(tmp_path)).collect()) == sorted(f"h{i}" for i in range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("both", [True, False])
def test_gated_counts_give_the_same_verdicts(spark, made, both):
    _, refs, reads = made
    rows = spark.createDataFrame([(i, x.lower()) for i, x in enumerate(reads + ["", "é" * 40, refs[0][:40] + "é" + refs[0][41:90]])], "read_id int, seq string")
    known = spark.createDataFrame([(refs[0].lower(),)], "t string")
    known = kmers.kmer_set(known, "t", K)
    verdict = ["read_id", "contaminated", "hits", *(["fwd_pass", "rev_pass"] if both else [])]
    for threshold in (0.2, 0.6):
        ways = [classify.window_counts(rows, known, K, ["read_id"], both=both, threshold=t, ship=s) for t, s in ((threshold, None), (None, None), (threshold, 0))]
        out = [sorted(classify.verdicts(w, K, threshold, both=both).select(*verdict).collect()) for w in ways]
        assert out[0] == out[1] == out[2] and sum(r.contaminated for r in out[0]) > 5


def test_shipped_filter_equals_joined_filter(spark, made, monkeypatch):
    d, _, _ = made
    path = screen.build(spark, str(d / "r0.fasta"), str(d / "b0.bloom"))
    pick = lambda: sorted(tuple(r) for r in screen.classified(spark, str(d / "s0.fastq"), path).select("read_no", "contaminated", "hits").collect())
    shipped = pick()
    plan = screen.classified(spark, str(d / "s0.fastq"), path)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    monkeypatch.setattr(bloom, "SHIP_BITS", 0)
    assert pick() == shipped and sum(c for _, c, _ in shipped) > 5


def test_filter_kernel_asks_as_the_join_does(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcé") for _ in range(400))
    known = kmers.kmer_set(spark.createDataFrame([(text[:200],)], "t string"), "t", 5)
    sizing = params.sizing(300, 0.05)
    words = bloom.build_jenkins(known, sizing)
    asked = kmers.kmer_set(spark.createDataFrame([(text,)], "t string"), "t", 5)
    want = {r.kmer: r.in_filter for r in bloom.contains_jenkins(asked, words, sizing).collect()}
    kernel = screen._shipped(words, 5, sizing).get()
    read, pos, _ = kernel.matches([text])
    assert {text[p : p + 5] for p in pos.tolist()} == {x for x, v in want.items() if v} and not all(want.values())


def test_many_samples_and_filters_in_one_pass(spark, made, monkeypatch):
    d, _, _ = made
    paths = screen.build_list(spark, [str(d / "r0.fasta"), str(d / "r1.fasta")], str(d / "many") + "/")
    samples = [str(d / "s0.fastq"), str(d / "s1.fastq")]
    columns = ["sample", "bloom_filter", "total_read_count", "contaminated_reads", "total_hits", "contamination_rate", "p_value"]
    got = sorted(screen.query_many(spark, samples, paths).select(columns).collect())
    alone = sorted(screen.query(spark, s, f).select(columns).first() for s in samples for f in paths)
    assert got == alone and len(got) == 4
    monkeypatch.setattr(bloom, "SHIP_BITS", 0)
    assert sorted(screen.query_many(spark, samples, paths).select(columns).collect()) == alone


def test_lists_keep_filters_and_splits_apart(spark, made, tmp_path, capsys):
    d, _, _ = made
    (tmp_path / "list.txt").write_text(f"{d}/r0.fasta\n{d}/r1.fasta\n")
    assert main(["build", "-l", str(tmp_path / "list.txt"), "-o", str(tmp_path / "filters")]) == 0
    found = filters.listed(spark, str(tmp_path / "filters"))
    assert [f.rpartition("/")[2] for f in found] == ["r0.bloom", "r1.bloom"]
    out = str(tmp_path / "out")
    assert main(["remove", "-r", str(tmp_path / "filters"), "-q", f"{d}/s0.fastq", "-o", out]) == 0
    for i, f in enumerate(found):
        rows = screen.classified(spark, f"{d}/s0.fastq", f)
        for verdict, flag in (("contam", True), ("clean", False)):
            lines = spark.read.text(f"{out}/s0_r{i}/verdict={verdict}").count()
            assert lines == 4 * rows.filter(F.col("contaminated") == flag).count()
    capsys.readouterr()
    assert main(["remove", "-r", found[0], "-q", f"{d}/s0.fastq"]) == 0
    streams = capsys.readouterr()
    rows = screen.classified(spark, f"{d}/s0.fastq", found[0])
    assert streams.out.count("\n") == 4 * rows.filter("not contaminated").count()
    assert streams.err.count("\n@q") + streams.err.startswith("@q") == rows.filter("contaminated").count()
    with pytest.raises(ValueError):
        screen.build_list(spark, [f"{d}/r0.fasta", f"{tmp_path}/r0.fasta"])


def test_list_capacity_of_fastq_is_half(spark, made, tmp_path):
    d, _, _ = made
    size = filters.total_size(spark, str(d / "s0.fastq"))
    one = screen.build_list(spark, [str(d / "s0.fastq")], f"{tmp_path}/")[0]
    assert filters.load(spark, one)[2].capacity == size // 2
    assert filters.load(spark, screen.build(spark, str(d / "s0.fastq"), str(tmp_path / "x.bloom")))[2].capacity == size


def test_print_split_order(spark):
    rows = spark.createDataFrame([("a\n", True), ("b\n", False), ("c\n", True)], "raw string, contaminated boolean").coalesce(1)
    clean, bad = io.StringIO(), io.StringIO()
    fastx.print_split(rows, clean, bad)
    assert (clean.getvalue(), bad.getvalue()) == ("b\n", "a\nc\n")


def test_screening_table_to_rate(spark, tmp_path):
    head = "#Fastq_screen version: 0.4.2\n" + "\t".join(tables.SCREEN_COLUMNS) + "\n"
    row = lambda name, a, b, c: "\t".join([name, "100", "1", "1.0", "2", str(a), "3", str(b), "4", str(c), "0", "0.0"]) + "\n"
    (tmp_path / "s1_screen.txt").write_text(head + row("eco", 1.5, 2.0, 0.5) + row("hum", 50.0, 1.0, 1.0) + "\n%Hit_no_libraries: 3\n")
    (tmp_path / "s2_screen.txt").write_text(head + row("eco", 0.0, 0.0, 0.0))
    rows = tables.read_screen_reports(spark, str(tmp_path))
    assert {r.sample: r.contamination_rate for r in compare.screen_rate(rows).collect()} == pytest.approx({"s1_screen": 0.04, "s2_screen": 0.0})
    assert [len(r.organisms) for r in rows.orderBy("sample").collect()] == [2, 1]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "b.conf").write_text("[kscreen]\nStore = /x/y  \nfilters=/f\n")
    (tmp_path / "c.conf").write_text("[other]\na=1\n")
    places = lambda *names: tuple(str(tmp_path / n) for n in names)
    assert settings(places("none", "b.conf", "c.conf")) == {"store": "/x/y", "filters": "/f"}
    assert settings(places("c.conf", "b.conf")) == {} == settings(places("none"))


def test_shipped_set_is_counted_first(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "abcdefghijklmnopqrst")], "read_id int, seq string").withColumn("seq", ascii_lower(F.col("seq")))
    known = spark.createDataFrame([("abcdefghijklmno",), ("bcdefghijklmnop",)], "kmer string")
    monkeypatch.setattr(classify, "shipped", lambda *a: pytest.fail("shipped"))
    assert classify.window_counts(rows, known, K, ["read_id"], ship=1).first().fwd_m == 2
