"""Quality classifier by co-training of two views of a document.

One view sees the content of the text, the other its metadata: language, source, stated
length. Each has a logistic regression. Over some rounds each labels documents of a pool
that have no label; those of which it is confident, by its calibrated probability, become
examples for the other view. In the end the calibrated views are combined, and score all
documents where these are, by column expressions.

Both are fitted on the driver from a bounded sample: at most MOST_LABELLED labelled
documents and a pool of at most MOST_POOL others, both chosen by a hash of the doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.llm.storage import computed_once, written

MOST_LABELLED = 20_000
MOST_POOL = 20_000
ROUNDS = 3
#: A view is confident where its calibrated probability of a class is at least this.
CONFIDENT = 0.97
#: Of its confident labels in a round, the share of the pool that a view passes on per class.
PASSED_ON = 0.1
PSEUDO_WEIGHT = 0.5
FOLDS = 5
RIDGE = 1e-2
THRESHOLD = 0.5
WORD = r"[^\x20\x09-\x0D]+"
CONTENT = ("capitals", "symbols", "marks", "digits", "word_length", "variety", "runs", "log_words")
LANGS, SOURCES, LENGTHS = 16, 64, 24


def content_features(text: Column) -> list[Column]:
    """The features of CONTENT, none null; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    root_share = lambda pattern: F.sqrt(
        (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    )

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        runs = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
        return F.struct(
            (F.length(F.array_join(w, "")) / n).alias("length"),
            (F.log(F.size(F.array_distinct(w)) + F.lit(1.0)) / F.log(n + 1.0)).alias("variety"),
            F.sqrt(runs / n).alias("runs"),
            F.log(n + 1.0).alias("log_words"),
        )

    per_word = F.get(F.transform(F.array(words), of_words), F.lit(0))
    return [
        F.struct(
            root_share(r"\p{Lu}+").alias("capitals"),
            root_share(r"[#*$%&|<>]+").alias("symbols"),
            root_share(r"[^\p{L}\p{Nd}\x20\x09-\x0D#*$%&|<>]+").alias("marks"),
            root_share(r"\p{Nd}+").alias("digits"),
            F.least(per_word["length"], F.lit(50.0)).alias("word_length"),
            per_word["variety"].alias("variety"),
            per_word["runs"].alias("runs"),
            per_word["log_words"].alias("log_words"),
        )
    ]


def metadata_buckets() -> list[Column]:
    """Buckets of language, source and length, by position in the metadata view's weights.

    Null is a value as any other. Languages and sources are hashed.
    """
    hashed = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    length = F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    return [
        hashed("lang", LANGS).alias("lang_bucket"),
        (LANGS + hashed("source", SOURCES)).alias("source_bucket"),
        (LANGS + SOURCES + F.least(F.floor(F.log2(length + 1)), F.lit(LENGTHS - 1))).cast("int").alias("length_bucket"),
    ]


def _features(docs: DataFrame, name: str) -> DataFrame:
    value = F.struct(content_features(F.col("text"))[0].alias("content"), *metadata_buckets())
    return computed_once(docs, name, value, docs.columns)


@dataclass
class Linear:
    """A logistic regression and the two numbers that calibrate its logit."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> Linear:
    """Ridge logistic regression by Newton steps on standardised features."""
    total = weight.sum()
    mean = weight @ x / total
    scale = np.sqrt(weight @ (x - mean) ** 2 / total)
    scale[scale < 1e-9] = np.inf
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    rate = np.clip(weight @ y / total, 1e-3, 1 - 1e-3)
    beta = np.zeros(z.shape[1])
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.full(z.shape[1], ridge * total)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = _sigmoid(z @ beta)
        gradient = z.T @ (weight * (p - y)) + penalty * beta
        gradient[-1] -= penalty[-1] * beta[-1]
        curvature = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / scale
    return Linear(weights, float(beta[-1] - weights @ mean))


def calibrated(x: np.ndarray, y: np.ndarray, more: tuple | None) -> tuple[Linear, np.ndarray]:
    """A model of all rows, calibrated by the logits of models that have not seen them.

    ``more`` are further rows, their labels and weights, on which all the models learn too.
    Also returns the calibrated held-out logits of the rows.
    """
    extra_x, extra_y, extra_w = more or (x[:0], y[:0], y[:0])
    fold = np.arange(len(y)) % FOLDS
    held = np.empty(len(y))
    for k in range(FOLDS):
        own = fold != k
        model = fit(
            np.vstack([x[own], extra_x]),
            np.append(y[own], extra_y),
            np.append(np.ones(own.sum()), extra_w),
        )
        held[~own] = model.logit(x[~own])
    platt = fit(held[:, None], y, np.ones(len(y)), ridge=1e-4)
    model = fit(
        np.vstack([x, extra_x]), np.append(y, extra_y), np.append(np.ones(len(y)), extra_w)
    )
    model.slope, model.shift = max(float(platt.weights[0]), 0.0), float(platt.bias)
    return model, model.slope * held + model.shift


def co_train(
    views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS
) -> tuple[list[Linear], Linear]:
    """The calibrated models of both views, and the combination of their logits.

    ``views`` and ``pool`` hold the two feature matrices of the labelled rows and of the
    others. In a round each view passes on what it is most confident of, of either class.
    """
    given: list[tuple | None] = [None, None]
    free = np.ones(len(pool[0]), bool)
    most = max(1, int(PASSED_ON * len(free)))
    for _ in range(rounds):
        models = [calibrated(v, y, g)[0] for v, g in zip(views, given)]
        passed = []
        for model, x in zip(models, pool):
            p = _sigmoid(model.logit(x))
            picked = []
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                rows = np.flatnonzero(free & (sure >= CONFIDENT))
                rows = rows[np.argsort(-sure[rows], kind="stable")[:most]]
                picked.append((rows, np.full(len(rows), label)))
            passed.append(tuple(np.concatenate(part) for part in zip(*picked)))
        # Rows on which the views contradict each other teach neither.
        told = {}
        for rows, labels in passed:
            for row, label in zip(rows.tolist(), labels.tolist()):
                told[row] = label if told.get(row, label) == label else None
        for view, (rows, labels) in ((1, passed[0]), (0, passed[1])):
            agreed = np.array([told[r] is not None for r in rows.tolist()], bool)
            rows, labels = rows[agreed], labels[agreed]
            new = (pool[view][rows], labels, np.full(len(rows), PSEUDO_WEIGHT))
            given[view] = new if given[view] is None else tuple(
                np.concatenate(pair) for pair in zip(given[view], new)
            )
        free[[r for r in told]] = False
    models, logits = zip(*(calibrated(v, y, g) for v, g in zip(views, given)))
    return list(models), fit(np.column_stack(logits), y, np.ones(len(y)), ridge=1e-4)


def _matrices(rows) -> list[np.ndarray]:
    content = np.array([tuple(r["content"]) for r in rows], float).reshape(len(rows), len(CONTENT))
    metadata = np.zeros((len(rows), LANGS + SOURCES + LENGTHS))
    for i, r in enumerate(rows):
        metadata[i, [r["lang_bucket"], r["source_bucket"], r["length_bucket"]]] = 1.0
    return [content, metadata]


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[Linear], Linear] | float:
    """What ``co_train`` learns from ``docs`` and ``labels (doc_id, quality 0/1)``.

    Labels that are null, of no document or contradict each other do not count. With fewer
    than FOLDS labels of a class the result is a constant probability, the share of good ones;
    it tells no document from another, so it is THRESHOLD at least, which keeps all.
    """
    order = lambda salt: F.xxhash64("doc_id", F.lit(salt))
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").alias("label"))
    )
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    known = agreed.join(ids, "doc_id", "left_semi").orderBy(order("labelled")).limit(MOST_LABELLED)
    others = ids.distinct().orderBy(order("pool")).limit(MOST_POOL).withColumn("label", F.lit(None).cast("int"))
    chosen = written(
        known.unionByName(others).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    # At most MOST_LABELLED + MOST_POOL ids.
    sample = docs.join(F.broadcast(chosen), "doc_id")
    rows = (
        _features(sample.select("doc_id", "label", "text", "lang", "source", "n_chars"), "f")
        .select("doc_id", "label", "f.*")
        .dropDuplicates(["doc_id"])
        .orderBy(order("fold"), "doc_id")
        .collect()
    )
    labelled = [r for r in rows if r["label"] is not None]
    y = np.array([r["label"] for r in labelled], float)
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < FOLDS:
        return max(float((y.sum() + 1) / (len(y) + 2)), THRESHOLD)
    return co_train(_matrices(labelled), y, _matrices([r for r in rows if r["label"] is None]))


def _probability(model: tuple[list[Linear], Linear] | float, name: str) -> list[Column]:
    """Score, and the calibrated probability of each view."""
    if isinstance(model, float):
        return [F.lit(model).alias(n) for n in ("score", "content_score", "metadata_score")]
    (content, metadata), combined = model
    of = lambda c: F.col(f"{name}.{c}")
    sum_ = F.lit(float(content.bias))
    for feature, weight in zip(CONTENT, content.weights.tolist()):
        sum_ = sum_ + F.lit(weight) * of(f"content.{feature}")
    weights = F.array(*(F.lit(w) for w in metadata.weights.tolist()))
    other = F.lit(float(metadata.bias))
    for bucket in ("lang_bucket", "source_bucket", "length_bucket"):
        other = other + F.get(weights, of(bucket))
    logits = [
        F.lit(m.slope) * z + F.lit(m.shift) for m, z in ((content, sum_), (metadata, other))
    ]
    both = F.lit(float(combined.bias))
    for weight, logit in zip(combined.weights.tolist(), logits):
        both = both + F.lit(weight) * logit
    squash = lambda z: 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))
    return [squash(both).alias("score")] + [
        squash(z).alias(n) for z, n in zip(logits, ("content_score", "metadata_score"))
    ]


def scored(
    docs: DataFrame, labels: DataFrame, name: str = "quality", learned: DataFrame | None = None
) -> DataFrame:
    """``docs`` with a struct ``name``: score, content_score, metadata_score, kept.

    ``docs`` has doc_id, text, lang, source, n_chars, any of them null; a null text is an
    empty one, and null metadata is a value. Rows stay as they are, with their other
    columns, of which none may be called ``name``. score is the probability of good
    quality; kept is whether it reaches THRESHOLD. With fewer than FOLDS labels of a class all
    documents have the same score, and all are kept. The model learns from ``learned``, which
    has the same columns, or else from ``docs``.
    """
    model = learn(docs if learned is None else learned, labels)
    work = f"_{name}_features"
    rows = _features(docs, work)
    return rows.withColumn(name, F.struct(*_probability(model, work))).withColumn(
        name, F.struct(f"{name}.*", (F.col(f"{name}.score") >= THRESHOLD).alias("kept"))
    ).select(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, content_score, metadata_score, kept`` of each row of ``docs``."""
    found = scored(docs, labels)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "quality.*")


def keep(docs: DataFrame, labels: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with its columns; it learns as in ``scored``."""
    name = "_quality" + "_" * max(map(len, docs.columns))
    return scored(docs, labels, name, learned).where(F.col(f"{name}.kept")).select(*docs.columns)
