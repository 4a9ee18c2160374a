"""Queries of the operators over the whole given tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envtally.llm import (
    ann,
    byte_bpe,
    co_training,
    exact_dedup,
    language_id,
    mixing,
    periodic_runs,
    phrases,
    quality_rules,
    simhash,
    token_counts,
    url_filter,
    warc_fixity,
)
from envtally.llm.oracle_sql import EXACT_DEDUP, FIXITY, QUALITY_RULES, URL_FILTER

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def _quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def _byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(byte_bpe.encode(docs, ["doc_id"], RANKS, PATTERN), ["doc_id"])


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), globs=url_filter.GLOBS)


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ["doc_id"], RANKS, PATTERN)


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def _fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica of the pages' WARC files that has rotted by a fixed rule.

    Every 101st page has its last character replaced, every 103rd is cut to half, and of
    every fifth file the records from the 200th on are lost.
    """
    records = warc_fixity.page_records(table(spark, sf_dir, "pages"))
    text, page = F.col("text"), F.col("page_id")
    rotten = (
        F.when(page % 101 == 7, F.concat(F.expr("left(text, length(text) - 1)"), F.lit("~")))
        .when(page % 103 == 9, F.expr("left(text, length(text) div 2)"))
        .otherwise(text)
    )
    length, digest = warc_fixity.range_digest(text)
    found_length, found = warc_fixity.range_digest(rotten)
    hashed = records.select(
        "page_id", length.alias("length"), digest.alias("digest"),
        found_length.alias("found_length"), found.alias("found"),
    )
    laid_out = warc_fixity.written(warc_fixity.layout(hashed))
    place = ["index", "file", "ordinal", "offset"]
    whole = laid_out.select(*place, "length", "digest", F.lit(0).alias("replica"))
    copy = laid_out.where("NOT (file % 5 = 3 AND ordinal >= 200)").select(
        *place, F.col("found_length").alias("length"), F.col("found").alias("digest"), F.lit(1).alias("replica")
    )
    damage = warc_fixity.audit(whole.unionByName(copy))
    pages = laid_out.select("index", "page_id")
    return damage.join(pages, "index").select(
        "page_id", "file", "ordinal", "offset", "length", "expected", "found", "damage"
    )


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``; one document in ten, by its id, ends in a repetition.

    With h the CRC-32 of the decimal doc_id, that is one with h % 10 = 0 and a word. With
    g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), each of its n words from a on
    is replaced by that at a + (i - a) % p, and words are joined by a space. A document with
    no doc_id is left as it is.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a, period = F.col("g") % F.col("n"), 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    ending = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.element_at("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1),
    )
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = h % 10 == 0
    hashed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("w"))
    sized = hashed.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long"))).withColumn("a", a)
    text = F.when(F.col("n").isNotNull(), F.array_join(ending, " ")).otherwise(F.col("text"))
    return sized.withColumn("p", period).select("doc_id", text.alias("text"))


def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")), ["doc_id"])
    # The greatest length, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    spans = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    one = found.select("*", longest.alias("one")).select(
        "*", (-F.col("one.col2")).alias("start"), F.col("one.length"), (-F.col("one.col3")).alias("period")
    )
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(spans, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("document.doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_co_training": _co_training,
    "op2_language_id": _language_id,
    "op3_quality_rules": _quality_rules,
    "op4_byte_bpe": _byte_bpe,
    "op5_mixing": _mixing,
    "op6_url_filter": _url_filter,
    "op7_simhash_near_dedup": _simhash,
    "op8_token_counts": _token_counts,
    "op9_hash_prefix_forest": _ann,
    "op10_warc_fixity": _fixity,
    "op11_phrases": _phrases,
    "op12_periodic_runs": _periodic_runs,
    "op13_exact_dedup": _exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": QUALITY_RULES,
    "op6_url_filter": URL_FILTER,
    "op10_warc_fixity": FIXITY,
    "op13_exact_dedup": EXACT_DEDUP,
}
