"""The thin queries over the driver's tables; each derives its digest columns from an operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY_JSON, VOCABULARY_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.token_store import read_crc, write_store

    return read_crc(write_store(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY_JSON), 2))


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.shards import lpt_shards

    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    out = lpt_shards(docs, ["text"], size, 40, keep={"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.toxicity import fit, score, training_rows

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kscreen.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY_RANKS), public_tokenizers.PATTERN)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.warc import assemble, read_archives, write_archives

    captures = assemble(read_archives(write_archives(table(spark, sf_dir, "pages"))), payload=False)
    fields = F.from_json("metadata.fields", "map<string,string>")
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        fields["refers-to-page-id"].cast("long").alias("refers_to"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.embeddings import near_vectors

    found = near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kscreen.llm.super_kmers import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_lpt_shards, op3_decontamination, op4_toxicity, op5_bpe, op6_warc, op7_suffix_dedup, op8_minhash, op9_subspace_join, op10_super_kmers)}

ORACLE_SQL: dict[str, str] = {}
