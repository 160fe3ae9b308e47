import gzip

import pytest
from pyspark.sql import functions as F

from kscreen.functions import params
from kscreen.operators import bloom, compare, report
from kscreen.sources import fastx, filters, tables


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">one two\nACGT\nAC\r\n>empty\n>last\nTTTT")
    rows = sorted((r.header, r.seq) for r in fastx.read(spark, str(p)).collect())
    assert rows == [("empty", ""), ("last", "TTTT"), ("one two", "ACGTAC\r")]
    assert sorted(r.seq for r in fastx.read(spark, str(p), reference=True).collect()) == ["", "ACGTAC", "TTTT"]


def test_fasta_gz_equals_plain(spark, tmp_path):
    body = "".join(f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(500))
    (tmp_path / "a.fa").write_text(body)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(body)
    a, b = (fastx.read(spark, str(tmp_path / n)).select("header", "seq") for n in ("a.fa", "b.fa.gz"))
    assert a.count() == 500 and a.exceptAll(b).count() == 0


def test_fastq_over_many_splits(spark, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_text("".join(f"@r{i}\n{'ACGT' * 5}{i % 10}\n+\n@{'I' * 19}{i % 7}\n" for i in range(3000)) + "@cut\nAC\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = fastx.read(spark, str(p)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.header, r.seq[-1], r.qual[-1]) for r in rows) == sorted((f"@r{i}", str(i % 10), str(i % 7)) for i in range(3000))


def test_unknown_reference_raises(spark, tmp_path):
    (tmp_path / "x.txt").write_text("ACGT\n")
    with pytest.raises(ValueError):
        fastx.read(spark, str(tmp_path / "x.txt"), reference=True)


def test_split_write(spark, tmp_path):
    rows = spark.createDataFrame([(">a\nAC\n", True), (">b\nGT\n", False)], "raw string, contaminated boolean")
    fastx.write_split(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/verdict=contam")).collect()[0][0] == ">a"
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_dummy(spark):
    rows = fastx.dummy_fastq(spark, 3, "ACGT").orderBy("read_no").collect()
    assert [len(r.seq) for r in rows] == [4, 104, 104, 104] and rows[0].qual == "IIII"


def test_filter_round_trip(spark, tmp_path):
    sizing = params.sizing(100, 0.005)
    words = bloom.build(spark.createDataFrame([("acgt",), ("gggg",)], "kmer string"), sizing)
    filters.save(words, 4, sizing, 2, str(tmp_path / "g.bloom"))
    back, k, s, n = filters.load(spark, str(tmp_path / "g.bloom"))
    assert (k, s, n) == (4, sizing, 2) and back.exceptAll(words).count() == 0
    assert filters.info(spark, str(tmp_path / "g.bloom")).first().error_rate == "5.000000e-03"
    (tmp_path / "list.txt").write_text("a.bloom\nb.bloom")
    assert filters.listed(spark, str(tmp_path / "list.txt")) == ["a.bloom", "b.bloom"]
    assert [x.rpartition("/")[2] for x in filters.listed(spark, str(tmp_path))] == ["g.bloom"]
    assert filters.total_size(spark, str(tmp_path / "none")) == 0
    with pytest.raises(FileNotFoundError):
        filters.listed(spark, str(tmp_path / "none"))


def test_names():
    assert filters.filter_path("/x/ecoli.fa", None, False) == "ecoli.bloom"
    assert filters.filter_path("/x/ecoli.fa", "/out/", True) == "/out/ecoli.bloom"
    assert filters.filter_path("/x/ecoli.fa", "/out/z", False) == "/out/z"
    assert filters.split_paths("/d/x.fastq.gz", "/r/e.bloom", "/o/", "fastq") == ("/o/x.fastq_e_contam.fastq", "/o/x.fastq_e_clean.fastq")


def test_report_stores(spark, tmp_path):
    sums = spark.sql("select 201L total_read_count, 1L contaminated_reads, 36L total_hits, 20850L all_k")
    doc = report.document(report.with_rates(sums, 15), "s.fastq", "e.bloom", F.current_timestamp(), 8)
    tables.write_json(doc, str(tmp_path / "store"))
    tables.write_json(doc, str(tmp_path / "store"))
    assert tables.read_json(spark, str(tmp_path / "store")).count() == 2
    tables.write_tsv(doc, str(tmp_path / "tsv"))
    lines = [r[0].split("\t") for r in spark.read.text(str(tmp_path / "tsv")).collect()]
    assert lines[0] == list(report.TSV_COLUMNS) and lines[1][2:5] == ["201", "1", "0.004975"]


def test_screen_table(spark, tmp_path):
    (tmp_path / "s.txt").write_text("#version 1\nLibrary\tone\tmulti\nEcoli\t1.5\t2\nPhix\t0\tx\n\n%no hits 4\n")
    rows = tables.read_screen_table(spark, str(tmp_path / "s.txt"), ["library", "one", "multi"]).orderBy("library").collect()
    assert [(r.library, r.one, r.multi) for r in rows] == [("Ecoli", 1.5, 2.0), ("Phix", 0.0, None)]


def test_times(spark):
    df = spark.createDataFrame([("2013-01-01T10:00:00.250+0100", "2013-01-01T10:00:01.500Z"), ("2013-01-01T10:00:00", "x")], "a string, b string")
    got = [r[0] for r in df.select(compare.seconds_between(compare.parse_time(F.col("a")), compare.parse_time(F.col("b")))).collect()]
    assert got == [1.25, None]


def test_confusion(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "c boolean, p boolean")
    r = compare.confusion(df, F.col("c"), F.col("p")).first()
    assert (r.called, r.tp, r.fp, r.fn, r.tn, r.tpr, r.fpr, r.accuracy) == (2, 1, 1, 1, 1, 0.5, 0.5, 0.5)
