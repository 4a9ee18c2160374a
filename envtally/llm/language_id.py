"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent n-grams of 1 to 3 letters, in order. A document's own
profile is compared with that of each language: an n-gram that both have costs the
difference of its places, one that the language lacks costs PROFILE. The language of the
smallest out-of-place distance wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envtally.llm.storage import written

PROFILE = 300
#: Profiles are learned from about so many documents of a language, chosen by a hash.
SAMPLE = 2000
#: Languages whose profiles a task compares at a time, which bounds its table of places.
BLOCK = 256
#: Sampling rates of at most so many languages are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
#: No letter has a code point from here on.
_END = 0x33480
_SPACE = 32
_BITS = 21


def letter_table() -> np.ndarray:
    """For each code point its letter in lower case, or a space."""
    table = np.full(_END + 1, _SPACE, np.uint64)
    for c in range(_END):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def ngrams(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``text`` as sorted numbers, and how often each occurs.

    Whatever is no letter is a space, a run of spaces is one, and words have one on both
    sides. N-grams have no space inside.
    """
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letters = np.concatenate(([_SPACE], table[np.minimum(points, _END)], [_SPACE])).astype(np.uint64)
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] != _SPACE) | (letters[:-1] != _SPACE)
    letters = letters[kept]
    if len(letters) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = letters[:-1] << np.uint64(_BITS) | letters[1:]
    three = two[:-1] << np.uint64(_BITS) | letters[2:]
    all_ = np.concatenate((letters[letters != _SPACE], two, three[letters[1:-1] != _SPACE]))
    all_.sort()
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1]))
    return all_[first], np.diff(np.append(first, len(all_)))


def profile(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """The profiles of all languages: their n-grams, sorted, and a place of each per language."""

    def __init__(self, by_language: dict[str, np.ndarray]) -> None:
        self.languages = sorted(by_language)
        keys = [by_language[name] for name in self.languages]
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.places = np.full((len(self.keys) + 1, len(keys)), -1, np.int16)
        for column, own in enumerate(keys):
            self.places[np.searchsorted(self.keys, own), column] = np.arange(len(own))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a document's profile to each language's, 0 to 1."""
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(
            self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)],
            at[at < len(self.keys)],
            len(self.keys),
        )
        places = self.places[at]
        out = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(own))[:, None]))
        return out.sum(axis=0) / (PROFILE * len(own))


def nearest(own: list[np.ndarray], blocks: Iterable[Profiles]) -> list[tuple[str, float]]:
    """The language of the least distance to each profile of ``own``, and 1 less the distance.

    Of equal distances the first block and in it the first language counts.
    """
    best = [(UNKNOWN, 0.0, np.inf)] * len(own)
    for profiles in blocks:
        for i, keys in enumerate(own):
            if len(keys):
                distances = profiles.distances(keys)
                at = int(distances.argmin())
                if distances[at] < best[i][2]:
                    best[i] = (profiles.languages[at], float(1.0 - distances[at]), distances[at])
    return [(name, score) for name, score, _ in best]


def learn(docs: DataFrame) -> list[dict[str, np.ndarray]]:
    """Profiles of all languages of ``docs (doc_id, text, lang)``, BLOCK of them a dict.

    Rows without lang or text teach nothing. Of a language with more than SAMPLE documents,
    about SAMPLE are chosen by a hash of the doc_id; their whole texts count. A language whose
    documents hold no letter has no profile. Blocks are in code point order of their languages.
    N-grams are counted in the tasks and summed by Spark; the driver gathers PROFILE numbers
    per language, block by block.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rates = written(
        counts.select(F.col("lang").alias("_lang"), (F.lit(float(SAMPLE)) / F.col("n")).alias("_rate"))
    )
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_lang")).alias("bytes")).first()
    if size["n"] <= MOST_BROADCAST and (size["bytes"] or 0) <= 64 * MOST_BROADCAST:
        rates = F.broadcast(rates)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(rates, F.col("lang") == F.col("_lang")).where(
        F.coalesce(drawn, F.lit(0.0)) < F.col("_rate")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            found: dict[str, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(name, []).append(ngrams(text.as_py(), table))
            for name, parts in found.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(keys), pa.string()),
                        pa.array(keys.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "ngram", "n"],
                )

    counted = (
        sample.select("lang", "text")
        .mapInArrow(count, "lang string, ngram long, n long")
        .groupBy("lang", "ngram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)
    top = written(top.select("lang", "place", "ngram"))
    names = sorted(r["lang"] for r in top.where("place = 1").select("lang").collect())
    blocks = []
    for start in range(0, len(names), BLOCK):
        own = names[start : start + BLOCK]
        out: dict[str, list] = {name: [] for name in own}
        for row in sorted(top.where(F.col("lang").between(own[0], own[-1])).collect()):
            out[row["lang"]].append(row["ngram"])
        blocks.append({name: np.array(keys, np.int64).view(np.uint64) for name, keys in out.items()})
    return blocks


def identify(
    docs: DataFrame, learned: list[dict[str, np.ndarray]], keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keys, lang_pred, score`` for each row of ``docs``, from its whole text alone.

    lang_pred is a learned language, of equally near ones the first in code point order;
    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    score is 1 less the distance over the largest possible one. Texts of any length are read
    whole. Rows repeat as they come, an empty table gives none, and columns other than ``keys``
    are left out, whatever their names. Each block is broadcast, some 600 KB.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in learned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        # One block of languages, as is usual, is made ready once; of more, one is held at a time.
        only = Profiles(shared[0].value) if len(shared) == 1 else None
        for batch in batches:
            own = [profile(*ngrams(t.as_py() or "", table)) for t in batch.column(len(keys))]
            found = nearest(own, [only] if only else (Profiles(b.value) for b in shared))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keys)],
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                [*keys, "lang_pred", "score"],
            )

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Whether a document takes no part in learning: crc32 of its id mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from documents not held out."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(ids, "text", "lang")
    learned = learn(rows.where(~held_out(F.col("doc_id"))))
    return identify(rows, learned).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
