"""Merkle fixity audit of WARC replicas.

Records are laid out in WARC files in a fixed order; each has an offset range in its file. A
replica's tree has the records' hashes as leaves. A node above covers FANOUT ordered nodes
and hashes their offset ranges and hashes. RECORDS_PER_FILE is a power of FANOUT, so that
each file is a node. Two replicas are compared from the root down, one level at a time, and
only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envtally.llm.storage import written
from envtally.operators.ordering import with_position

FANOUT = 16
RECORDS_PER_FILE = FANOUT**2
#: Ends a record; the text writer puts it behind each row.
RECORD_END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
LEAF = "index long, file long, ordinal int, offset long, length long, digest string"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A page as a WARC resource record, without the two line ends behind it.

    Nulls are empty. A line end in a url is written as %0D or %0A.
    """
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )


def range_digest(text: Column) -> tuple[Column, Column]:
    """Length in bytes and hash of a record, the line ends behind it included."""
    whole = F.concat(text, F.lit(RECORD_END))
    return F.octet_length(whole).cast("long"), F.sha2(whole, 256)


def layout(records: DataFrame) -> DataFrame:
    """``records (page_id, length, digest, ...)`` with ``index, file, ordinal, offset``.

    The order is by page_id, nulls first, then by digest. Positions come from range
    partitions, so repeated page_ids do not gather in one task; no file has more than
    RECORDS_PER_FILE records. Rows that are equal in both may take either place.
    """
    kept = written(records.withColumn("_all", F.lit(0)))
    placed = with_position(kept, ["_all"], ["page_id", "digest"], "_position").drop("_all")
    index = (F.col("_position") - 1).cast("long")
    placed = placed.withColumns(
        {
            "index": index,
            "file": F.floor(index / RECORDS_PER_FILE).cast("long"),
            "ordinal": (index % RECORDS_PER_FILE).cast("int"),
        }
    ).drop("_position")
    before = F.expr(
        "coalesce(sum(length) OVER (PARTITION BY file ORDER BY ordinal"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    )
    return placed.withColumn("offset", before)


def write_warc(records: DataFrame, path: str) -> None:
    """Write the ``text`` of laid out records as WARC files, one in each folder file=N."""
    (
        records.repartition("file")
        .sortWithinPartitions("file", "ordinal")
        .select("file", F.col("text").alias("value"))
        .write.partitionBy("file")
        .option("lineSep", RECORD_END)
        .text(path)
    )


def stored_replica(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Leaves of the files that ``write_warc`` wrote, cut at the offset ranges of ``manifest``.

    A range that lies wholly behind the end of its file has no leaf. A file holds at most
    RECORDS_PER_FILE records, which bounds the list of its ranges.
    """
    found = F.regexp_extract("path", r"/file=(-?\d+)/[^/]*$", 1).cast("long")
    files = spark.read.format("binaryFile").load(path).select(found.alias("file"), "content")
    ranges = manifest.groupBy("file").agg(
        F.collect_list(F.struct("index", "ordinal", "offset", "length")).alias("ranges")
    )
    cut = files.join(ranges, "file").select(
        "file", "content", F.explode("ranges").alias("r")
    ).where("r.offset < length(content)")
    piece = F.expr("substring(content, cast(r.offset as int) + 1, cast(r.length as int))")
    return cut.select(
        "r.index", "file", "r.ordinal", "r.offset",
        F.length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("digest"),
    )


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels ``replica, index, digest, offsets`` of the trees of all replicas, leaves first.

    ``leaves`` has LEAF and ``replica``. The last level has one node per replica. All trees
    are as high as the highest one.
    """
    level = written(
        leaves.select(
            "replica", "index",
            F.concat_ws(":", "file", "offset", "length", "digest").alias("digest"),
        )
    )
    levels, top = [level], level.agg(F.max("index")).first()[0]
    while top:
        children = F.array_sort(F.collect_list(F.struct("index", "digest")))
        level = written(
            level.groupBy("replica", F.floor(F.col("index") / FANOUT).cast("long").alias("parent"))
            .agg(F.sha2(F.to_json(children), 256).alias("digest"))
            .withColumnRenamed("parent", "index")
        )
        levels.append(level)
        top //= FANOUT
    return levels


def differing(levels: list[DataFrame], left: int, right: int) -> DataFrame:
    """``index`` of the leaves that differ, found from the roots down."""
    suspects = None
    for level in reversed(levels):
        if suspects is not None:
            parents = suspects.withColumnRenamed("index", "_parent")
            level = level.join(
                parents, F.floor(F.col("index") / FANOUT).cast("long") == F.col("_parent"), "left_semi"
            )
        sides = (F.max(F.when(F.col("replica") == r, F.col("digest"))) for r in (left, right))
        digests = dict(zip(("_l", "_r"), sides))
        suspects = (
            level.groupBy("index")
            .agg(*(d.alias(n) for n, d in digests.items()))
            .where("NOT (_l <=> _r)")
            .select("index")
        )
    return suspects


def audit(leaves: DataFrame, left: int = 0, right: int = 1) -> DataFrame:
    """The damage of one replica, measured by another: a row for each record that differs.

    ``leaves`` has LEAF, and ``replica``; in a replica, indexes must be distinct. damage is
    ``missing`` (in left only), ``extra`` (in right only) or ``altered``; expected and found
    are the hashes in left and right. Equal replicas, and empty ones, give no rows.
    """
    leaves = written(leaves)
    # Few leaves as a rule, but nothing bounds them: the join is left to the planner.
    bad = leaves.join(differing(tree(leaves), left, right), "index", "left_semi")
    of = lambda name, r: F.max(F.when(F.col("replica") == r, F.col(name)))
    either = lambda name: F.coalesce(of(name, left), of(name, right)).alias(name)
    return bad.groupBy("index").agg(
        *(either(name) for name in ("file", "ordinal", "offset", "length")),
        of("digest", left).alias("expected"),
        of("digest", right).alias("found"),
        F.when(of("digest", right).isNull(), "missing")
        .when(of("digest", left).isNull(), "extra")
        .otherwise("altered")
        .alias("damage"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of each row of ``pages (page_id, url, html)`` as a record."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record(F.col("page_id"), F.col("url"), F.col("html")).alias("text"),
    )
