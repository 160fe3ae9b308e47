import random

import pytest

from kscreen.__main__ import main
from kscreen.plans import screen
from kscreen.streaming.screen import running_totals, split_batches

SPIKE = "AGCTTTTCATTCTGACTGCAACGGGCAATATGTCTCTGTGTGGATTAAAA"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("screen")
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(2000)) + SPIKE
    (d / "ref.fasta").write_text(">g\n" + "\n".join(genome[i : i + 60] for i in range(0, len(genome), 60)) + "\n")
    reads = [SPIKE] + ["GATTACAT" * 13] * 200
    (d / "s.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    return d


@pytest.mark.parametrize("exact", [False, True])
def test_build_query_remove_info(spark, files, exact):
    path = screen.build(spark, str(files / "ref.fasta"), str(files / f"g{exact}.bloom"))
    assert screen.info(spark, path).first().word_size == 15
    r = screen.query(spark, str(files / "s.fastq"), path, exact=exact).first()
    assert (r.total_read_count, r.contaminated_reads, r.total_hits) == (201, 1, 36)
    screen.remove(spark, str(files / "s.fastq"), path, str(files / f"out{exact}"), exact=exact)
    assert [x[0] for x in spark.read.text(str(files / f"out{exact}/verdict=contam")).collect()][:2] == ["@r0", SPIKE]
    assert spark.read.text(str(files / f"out{exact}/verdict=clean")).count() == 800


def test_command_line(spark, files, capsys):
    assert main(["build", "-r", str(files / "ref.fasta"), "-o", str(files / "cli.bloom"), "-e", "0.005"]) == 0
    assert main(["query", "-r", str(files / "cli.bloom"), "-q", str(files / "s.fastq"), "-f", "tsv"]) == 0
    assert "contamination_rate" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_missing_reference_raises(spark, files):
    with pytest.raises(ValueError):
        screen.build(spark, str(files / "none.fasta"))


def test_split_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a", True), (2, 0, "b", False)], "doc_id long, tile_no int, seq string, contaminated boolean")
    write = split_batches(str(tmp_path))
    write(rows, 0)
    write(rows, 0)  # a batch that runs again replaces itself
    assert spark.read.parquet(str(tmp_path)).groupBy("verdict").count().count() == 2
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_running_totals(spark):
    rows = spark.createDataFrame([("a", True, 3, 10), ("a", False, 0, 5)], "source string, contaminated boolean, hits long, read_len long")
    assert tuple(running_totals(rows, "source").first()) == ("a", 2, 1, 3, 15)
