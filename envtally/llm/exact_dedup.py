"""Exact duplicates by a tree merge of sorted digest runs.

Each partition of the documents is a run of (digest, proof, smallest id): the digest orders
a run, the SHA-256 of the normalised text proves that two of its entries are one text. Runs
are the leaves of a tree of FAN_IN children a node (a binomial tree of that radix). In each
round the runs below a node are exchanged and merged, and of equal entries that with the
smallest identifier is retained. The exchange is by node and digest, so that every task
works on a share of every merge and none gathers a whole run. A text that fills a third of
the table is one entry per run after the first partial merge, and FAN_IN entries at a node
at most. What the root finds goes back to the leaves that hold copies, not to the key of
the text, so that the rows of such a text stay spread as they were read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.llm.storage import written

FAN_IN = 16
ROUNDS = 3
BLANKS = r"[\x20\x09-\x0D]+"
_ENTRY = ("_digest", "_proof")


def normalised(text: Column) -> Column:
    """The text with each stretch of white space as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def _runs(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per document: its leaf, its place in it, its digests, and ``columns``."""
    normal = normalised(F.col("_text"))
    return written(
        docs.select(
            F.struct(*columns).alias("_kept_columns"),
            F.col("doc_id").alias("_id"),
            F.col("text").alias("_text"),
            F.monotonically_increasing_id().alias("_row"),
        )
        .select(
            "_kept_columns",
            "_id",
            "_row",
            # The upper 31 bits are the partition.
            (F.shiftrightunsigned("_row", 33) % FAN_IN**ROUNDS).cast("int").alias("_leaf"),
            F.xxhash64(normal).alias("_digest"),
            F.unhex(F.sha2(normal, 256)).alias("_proof"),
        )
        .sortWithinPartitions(*_ENTRY, "_id")
    )


def _merged(runs: DataFrame) -> DataFrame:
    """The root's run: ``_digest, _proof, _keep_id, _keep_row, _size, _leaves``."""
    entries = runs.select(
        *_ENTRY,
        F.col("_leaf").alias("_node"),
        F.col("_id").alias("_keep_id"),
        F.col("_row").alias("_keep_row"),
        F.lit(1).cast("long").alias("_size"),
        F.array("_leaf").alias("_leaves"),
    )
    for level in range(ROUNDS):
        # A leaf's own copies are merged along with the first round.
        leaves = F.collect_set(F.element_at("_leaves", 1)) if level == 0 else F.flatten(F.collect_list("_leaves"))
        entries = (
            entries.withColumn("_node", F.floor(F.col("_node") / FAN_IN).cast("int"))
            .groupBy(*_ENTRY, "_node")
            .agg(
                F.min("_keep_id").alias("_least"),
                F.coalesce(F.min_by("_keep_row", "_keep_id"), F.min("_keep_row")).alias("_least_row"),
                F.sum("_size").alias("_size"),
                leaves.alias("_leaves"),
            )
            .withColumnsRenamed({"_least": "_keep_id", "_least_row": "_keep_row"})
        )
    return entries


def exact_duplicates(docs: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row of ``docs (doc_id, text, ...)`` its group of equal texts.

    Returns ``document`` (a struct of ``columns``), ``keep_id, group_size, kept,
    text_sha256``. Texts are equal when identical with each stretch of space and 0x09-0x0D
    as one space. One row of a group is kept: the one with the smallest doc_id.

    Null and empty texts are one group; a text of blanks only is a single space, another
    group. A null doc_id comes after all others, and keep_id is null only where the whole
    group has none. Of rows with the same smallest doc_id exactly one, any, is kept. Texts
    of any length are digested whole. No rows give no rows. Other columns may have any name.
    """
    runs = _runs(docs, columns)
    found = (
        _merged(runs)
        .where("_size > 1")
        .select(*_ENTRY, "_keep_id", "_keep_row", "_size", F.explode("_leaves").alias("_leaf"))
    )
    return runs.join(found, [*_ENTRY, "_leaf"], "left").select(
        F.col("_kept_columns").alias("document"),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_proof")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return exact_duplicates(docs, docs.columns).where("kept").select("document.*")
