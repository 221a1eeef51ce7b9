"""The text operators as queries over the test tables, and the SQL that some must equal."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from creaseline.llm import (
    decontamination, embeddings, languages, lines, middles, pieces, sharding, simhash, suffixes, transducer, vector_codes,
    vector_search, warc,
)
from creaseline.llm.oracles import ORACLES
from creaseline.sources.storage import scratch_path


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


SHARD_BYTES = 64 << 20


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign(documents(spark, d).select("doc_id", "text"), SHARD_BYTES)


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document; three quarters of the labelled documents may teach it."""
    docs = documents(spark, d)
    model = languages.learn(docs, ~languages.held_out())
    predicted = languages.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every document that are not the first of their kind."""
    judged = lines.judge(documents(spark, d))
    return judged.select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
        F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"),
    )


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch_path(spark, "warc")
    warc.write(spark.read.parquet(f"{d}/pages.parquet"), path)
    return warc.digests(warc.payloads(warc.reassembled(warc.read(spark, path))))


def op5_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    """What repeats of 50 bytes leave of every document."""
    cut = suffixes.remove_repeats(documents(spark, d))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, d))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op7_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


def op8_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded; counts and digests."""
    docs = documents(spark, d).select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark windows that stand in every document."""
    judged = decontamination.judge(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document."""
    docs = documents(spark, d).select("doc_id", "text")
    counted = transducer.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every vector coded by four codebooks, with its error and the codebooks' digest."""
    coded, books = vector_codes.compress(spark.read.parquet(f"{d}/embeddings.parquet"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def op12_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose vec_id is divisible by 50."""
    return vector_search.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op13_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and rebuilt."""
    return middles.digests(middles.transform(documents(spark, d).select("doc_id", "text")))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_embeddings": op7_embeddings,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_vector_search": op12_vector_search,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}
