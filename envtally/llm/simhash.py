"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes,
so they share the byte at 4 positions or more: the guaranteed minimum. A posting list per
single positional byte would pair every fingerprint with one in 256 of all others. The lists
are therefore keyed by the positional bytes of three positions. The 20 triples of BLOCKS
are a Turan system: any 4 of the 8 positions contain one of them, so every linked pair meets
in a list. There its shared positional bytes are tallied, pairs below the minimum are
dropped and the others verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envtally.llm.components import connected_components
from envtally.llm.storage import written

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
BYTES = 8
#: Lists longer than this are dealt out as pairs of chunks to several tasks.
CHUNK = 4096
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
_HASHES_AT_ONCE = 1 << 15


def blocks() -> list[tuple[int, int, int]]:
    """Triples of byte positions of which any 4 positions contain one.

    Of four positions in three parts, three are in one part, or two in one part and one in
    the next, cyclically.
    """
    part = {p: i for i, positions in enumerate(_PARTS) for p in positions}

    def chosen(triple):
        of = sorted(part[p] for p in triple)
        if len(set(of)) == 1:
            return True
        if len(set(of)) == 3:
            return False
        twice = of[1]
        once = of[0] if of[2] == twice else of[2]
        return once == (twice + 1) % len(_PARTS)

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


BLOCKS = blocks()


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, unsigned; 0 without a word.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and 0x09-0x0D only.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        spans = zip(
            starts[at : at + _HASHES_AT_ONCE].tolist(), ends[at : at + _HASHES_AT_ONCE].tolist()
        )
        hashes = np.array([digest(text[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(
        np.packbits(2 * set_bits > len(starts), bitorder="little").tobytes(), "little"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` for each row of ``docs (doc_id, text)``; fp is signed.

    A null text is an empty one. text_hash tells rows that share a doc_id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.fromiter(
                (fingerprint(text.as_py()) for text in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``u, v`` between values of ``fps (fp)`` that connect what the links connect.

    Input values must be distinct. A list of n values makes at most n edges: a task joins
    what it has found to be linked and returns one edge for each value but the smallest.
    Long lists are cut into chunks of about CHUNK values by their hash, and each pair of
    chunks is a list of its own, so that no task has to compare a whole hot list.
    """
    postings = fps.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(b).alias("block"), F.col("fp").bitwiseAND(_mask(b)).alias("key"))
                    for b in range(len(BLOCKS))
                )
            )
        ).alias("p"),
    ).select("p.block", "p.key", "fp")
    sizes = (
        postings.groupBy("block", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("block", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = (
        postings.join(sizes, ["block", "key"])
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            F.col("block").cast("long").alias("block"),
            "key",
            F.least("chunk", "other").alias("a"),
            F.greatest("chunk", "other").alias("b"),
            "chunk",
            "fp",
        )
    )
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "block", "key", "a", "b")
        .sortWithinPartitions("block", "key", "a", "b", "fp")
        .select("block", "key", "a", "b", "fp")
        .mapInArrow(_linked, "u long, v long")
        .distinct()
    )


def _mask(block: int) -> int:
    mask = sum(0xFF << (8 * p) for p in BLOCKS[block])
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within the lists of a partition, which come sorted by list; lists are whole."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        starts = _starts(columns[:-1])
        if len(starts) < 2:
            rest = columns
            continue
        rest = [c[starts[-1] :] for c in columns]
        yield _edges(columns[-1][: starts[-1]], starts[:-1])
    if rest is not None and len(rest[0]):
        yield _edges(rest[-1], _starts(rest[:-1]))


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _edges(fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    values = fps.view(np.uint64)
    ends = np.repeat(np.append(starts[1:], len(fps)), np.diff(np.append(starts, len(fps))))
    label = np.arange(len(fps))
    left = label
    for shift in range(1, len(fps)):
        left = left[left + shift < ends[left]]
        if not len(left):
            break
        differing = values[left] ^ values[left + shift]
        shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        pairs = np.flatnonzero(shared >= BYTES - MAX_DISTANCE)
        pairs = pairs[np.bitwise_count(differing[pairs]) <= MAX_DISTANCE]
        if len(pairs):
            _join(label, left[pairs], left[pairs] + shift)
    hanging = np.flatnonzero(label != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays(
        [pa.array(fps[hanging]), pa.array(fps[_root(label, hanging)])], ["u", "v"]
    )


def _root(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = label[at]
        if np.array_equal(up, at):
            return at
        at = up


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Put both ends of each pair under one root: the smaller row."""
    while len(u):
        a, b = _root(label, u), _root(label, v)
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _classes(rows: DataFrame) -> DataFrame:
    """``fp, component`` of each distinct fp of ``rows``; component is its smallest fingerprint."""
    nodes = rows.select("fp").distinct()
    members = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(members, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs (doc_id, text)``.

    fingerprint is 16 hexadecimal digits. component_id is the smallest doc_id that links
    reach, the row's own included. Null texts, empty texts and texts without a word have
    fingerprint 0. A null doc_id counts only where a component has no other; component_id
    is null there. Repeated rows come out as often as they came in; other columns are not
    looked at. An empty table gives an empty result.

    Rows of equal fingerprint are one node of the graph: copies are never paired, and what
    is looked up for them has one row per fingerprint.
    """
    rows = written(fingerprints(docs))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = written(_classes(rows).join(least, "fp"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(ids, "component").select("fp", "component_id")
    return rows.join(written(known), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component: of its smallest doc_id, nulls last.

    Rows that share this doc_id but not their text count by the hash of the text; of equal
    rows one stays. The columns are those of ``docs``.
    """
    rows = written(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = rows.groupBy("fp").agg(F.min(order).alias("least"))
    first = _classes(rows).join(least, "fp").groupBy("component").agg(F.min("least").alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    name = "_hash_of_text" + "_" * max(map(len, docs.columns))
    hashed = docs.withColumn(name, F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(first["_id"]) & (hashed[name] == first["_hash"])
    return hashed.join(first, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
