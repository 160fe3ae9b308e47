"""A corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.llm import bpe, decontaminate, minhash, super_kmers, toxicity
from kscreen.llm.common import discard, read_back, row_key, store, taken
from kscreen.llm.queries import VOCABULARY_RANKS, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else docs has."""
    return taken(docs, **{c: c for c in COLUMNS})


# Cases of all stages: any column may be null; null and empty texts are documents without words, which no
# stage but the ones named drops; an empty table gives an empty one; columns beyond those of documents are
# left behind, whatever their names. Texts are processed whole, very long ones as the operators state.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3; the model is fitted on this stage's labelled rows.

    Equal texts have equal scores, so repeated rows go or stay together.
    """
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.with_score(columns(docs), model).filter("_score < 0.3").drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id, null last, and the least key where ids repeat.

    Of rows with equal id and text one stays; texts without words are no copies of each other.
    """
    found = minhash.near_duplicates(docs)
    blank = [F.when(F.col("n_shingles") == 0, F.col(c)) for c in ("k1", "k2")]
    least = found.groupBy("label", *[c.alias(f"own{i}") for i, c in enumerate(blank)]).agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("least"))
    kept = least.select("least.k1", "least.k2").distinct()
    rows = columns(docs).select(*COLUMNS, *row_key(F.col("doc_id"), F.col("text")))
    # equal rows have equal keys: one of them stays
    return rows.join(kept, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 35-word windows that occur more than once; other texts, null ones too, stay as they are.

    No row goes; repeated rows lose what they share with each other.
    """
    out = super_kmers.with_kept(columns(docs))
    text = F.when(F.col("_n_removed") > 0, F.col("_kept").cast("string")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within its edit budget; repeated rows go or stay together."""
    return decontaminate.matches(columns(docs), table(spark, sf_dir, "benchmark")).filter(F.size("_found") == 0).drop("_found")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; one row for each row."""
    import public_tokenizers

    return bpe.digests(docs, vocabulary(VOCABULARY_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Compression lengths, signatures and merges cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again; what a stage has worked with goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = store(out, f"stage-{name}")
        docs = read_back(out, path)
        discard(spark, path)
    return docs
