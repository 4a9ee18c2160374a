"""Quality rules: divergence of a text from its language, in DataFrame operations only.

Two histograms of a document are compared with those of its language by the Jensen-Shannon
distance (base 2, so 0 to 1): classes of characters, and the language's most common words.
The references are computed from all documents: the median share of each class, and the
shares of the words. A text too short for a histogram to mean anything is not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envtally.llm.storage import computed_once, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Characters of no class but space: letters that are no capitals, digits and blanks. The frequent
#: ones are listed one by one, which makes them a table that is looked at first.
PLAIN = r"[[abcdefghijklmnopqrstuvwxyz0123456789\x20\x09\x0A\x0B\x0C\x0D][\p{L}\p{Nd}&&[^\p{Lu}]]]+"
MIN_WORDS = 50
MOST_REPEATED = 50
#: Words in the histogram of a language, and the most code points of such a word.
COMMON = 16
COMMON_LENGTH = 6
#: Least code points and words of a text, and words of a language, for a histogram to count.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
MIN_REFERENCE_WORDS = 1000
#: Largest distances that pass.
MOST_CHAR_DISTANCE = 0.16
MOST_WORD_DISTANCE = 0.4
#: References of at most so many languages, about a kilobyte each, are broadcast; more are
#: joined by a shuffle.
MOST_BROADCAST = 10_000
#: A common word is at least one in so many of its language's words.
RAREST_COMMON = 1000
_CLASSES = ("upper", "symbol", "mark", "space")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, pattern: str) -> Column:
    """Code points of ``text`` in matches of ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """A 64-bit hash of each 3-word window of an array without nulls."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def _sorted_windows(hashes: Column) -> Column:
    """Windows and their places, equal ones adjacent; null if no two are equal."""
    placed = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed))


def _covered_words(sorted_windows: Column) -> Column:
    """Words in windows that occur again.

    In order of place, each window adds the words that the one before does not reach.
    """

    def again(x: Column, k: Column) -> Column:
        near = lambda j: F.coalesce(F.get(sorted_windows, j)["h"] == x["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    at = F.sort_array(F.transform(F.filter(sorted_windows, again), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")
    )
    return F.coalesce(F.aggregate(at, start, step, lambda a: a["n"]), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more; an array without nulls is given.

    Over many rows the three steps are faster as columns one after the other (``judged``):
    within a lambda, Spark sorts without generated code.
    """
    return _let(_windows(words), lambda h: _let(_sorted_windows(h), _covered_words))


def _words() -> Column:
    """A struct of the text, not null, and the words of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))


def _classes(text: Column, words: Column) -> Column:
    """A struct of the code points of each class: capitals, symbols, other marks, space.

    What is none of the first three is most of a text, and is taken out first.
    """

    def counted(few: Column) -> Column:
        upper, symbol = _removed(few, r"\p{Lu}+"), _removed(few, SYMBOLS)
        space = F.length(text) - F.length(F.array_join(words, ""))
        counts = (upper, symbol, F.length(few) - upper - symbol, space)
        return F.struct(*(c.cast("long").alias(n) for n, c in zip(_CLASSES, counts)))

    return _let(F.regexp_replace(text, PLAIN, ""), counted)


def _hits(words: Column, common: Column) -> Column:
    """How often each word of ``common`` is among ``words``, in COMMON places.

    Not in a condition, in which Spark would compute each step anew for all later ones.
    """
    left, counts = words, []
    for k in range(COMMON):
        rest = F.array_remove(left, F.coalesce(F.get(common, F.lit(k)), F.lit("")))
        counts.append(F.size(left) - F.size(rest))
        left = rest
    return F.array(*counts)


def _with_rest(shares: list[Column]) -> Column:
    """Shares with that of all other characters, in one array."""
    rest = F.lit(1.0)
    for share in shares:
        rest = rest - share
    return F.array(*shares, F.greatest(rest, F.lit(0.0)))


def references(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``lang, classes, common, shares, reference_words``; whether these are few.

    Each language with MIN_REFERENCE_WORDS words has a row, whatever its share of the corpus,
    and so have the documents whose lang is null, together. classes are the median shares of
    character classes; common are the COMMON most frequent words of at most COMMON_LENGTH
    letters and nothing else, ties in code point order; shares are theirs among all words, and
    last that of all other words. Few are at most MOST_BROADCAST rows with short names.
    """
    rows = computed_once(docs.select("lang", "text"), "w", _words(), ["lang"]).select("lang", "w.*")
    # One read of the texts counts words and shares: a share is an entry that starts with a
    # space, as no word does, then the number of the class, then thousandths, of which there
    # are 1001: a median of counts, not of documents.
    chars = F.length("text")
    shares = lambda c: F.array(
        *(F.concat(F.lit(f" {i}"), F.call_function("div", c[n] * 1000, chars).cast("string")) for i, n in enumerate(_CLASSES))
    )
    measured = F.when(chars > 0, _let(_classes(F.col("text"), F.col("words")), shares)).otherwise(F.array())
    entries = rows.select("lang", F.explode(F.concat("words", measured)).alias("word"))
    is_share = F.startswith("word", F.lit(" "))
    short = F.when((F.length("word") <= COMMON_LENGTH) | is_share, F.col("word"))
    counts = written(entries.groupBy("lang", short.alias("word")).agg(F.count(F.lit(1)).alias("n")))
    by_word = counts.where(~F.coalesce(is_share, F.lit(False)))
    by_share = counts.where(is_share).select(
        "lang", F.substring("word", 2, 1).alias("part"), F.substring("word", 3, 4).cast("long").alias("share"), "n"
    )
    sums = written(
        by_word.groupBy("lang")
        .agg(F.sum("n").alias("reference_words"))
        .where(F.col("reference_words") >= MIN_REFERENCE_WORDS)
    )
    size = sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("lang")).alias("bytes")).first()
    few = size["n"] <= MOST_BROADCAST and (size["bytes"] or 0) <= 64 * MOST_BROADCAST
    small = F.broadcast if few else lambda df: df
    medians = (
        by_share.groupBy(F.col("lang").alias("_m"))
        .agg(
            *(
                F.expr(f"percentile(share, 0.5, if(part = '{i}', n, 0L)) / 1000").alias(c)
                for i, c in enumerate(_CLASSES)
            )
        )
    )
    frequent = (
        by_word.where(F.rlike("word", F.lit(r"^\p{L}+$")))
        .join(
            small(sums.select(F.col("lang").alias("_l"), "reference_words")),
            F.col("lang").eqNullSafe(F.col("_l"))
            & (F.col("n") * RAREST_COMMON >= F.col("reference_words")),
        )
    )
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    listed = (
        frequent.withColumn("_rank", F.row_number().over(top))
        .where(F.col("_rank") <= COMMON)
        .groupBy(F.col("lang").alias("_l"))
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "word", "n"))).alias("top"))
    )
    share = lambda n: n.cast("double") / F.col("reference_words")
    known = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    found = (
        sums.join(small(listed), F.col("lang").eqNullSafe(F.col("_l")), "left")
        .join(small(medians), F.col("lang").eqNullSafe(F.col("_m")))
        .select(
            "lang",
            _with_rest([F.col(c) for c in _CLASSES]).alias("classes"),
            F.transform("top", lambda x: x["word"]).alias("common"),
            F.concat(
                F.transform("top", lambda x: share(x["n"])),
                F.array(share(F.col("reference_words") - known)),
            ).alias("shares"),
            "reference_words",
        )
    )
    return found, few


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(x: Column, y: Column) -> Column:
        part = lambda a: F.when(a > 0, a * F.log2(2 * a / (x + y))).otherwise(0.0)
        return part(x) + part(y)

    sum_ = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(sum_, F.lit(0.0)) / 2)


def judged(docs: DataFrame, name: str = "rules") -> DataFrame:
    """``docs`` (``lang, text`` and any others) with a struct ``name`` of what the rules find.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    char_distance and word_distance (null where the text, or the reference of its language,
    is too short to judge) and kept. A null text is an empty one, which fails the base
    rules; a text of any length is judged whole. Documents whose lang is null have a reference
    together. Repeated rows stay, each judged alike; other columns stay as they are, whatever
    their names, but ``name`` must not be one of them. An empty table gives an empty result.
    """
    reference, few = references(docs)
    ref, work = f"_{name}_reference", f"_{name}_work"
    known = reference.select(
        F.col("lang").alias(f"{ref}_lang"), F.struct("classes", "common", "shares", "reference_words").alias(ref)
    )
    same = F.col("lang").eqNullSafe(F.col(f"{ref}_lang"))
    if few:
        joined = docs.withColumn(work, _words()).join(F.broadcast(known), same, "left")
    else:
        # Only texts move, not their words as well; adaptive execution splits a hot language.
        joined = computed_once(docs.join(known, same, "left"), work, _words(), [*docs.columns, ref])
    text, words = F.col(f"{work}.text"), F.col(f"{work}.words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    common = F.col(f"{ref}.common")
    # Columns one after the other: see repeated_words.
    windows = f"{work}_windows"
    hashed = computed_once(joined, windows, _windows(words), [*docs.columns, ref, work])
    counted = computed_once(
        hashed,
        work,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.length(text).cast("long").alias("chars"),
            _classes(text, words).alias("classes"),
            _hits(words, common).alias("hits"),
            _sorted_windows(F.col(windows)).alias("windows"),
        ),
        [*docs.columns, ref],
    )
    measured = computed_once(
        counted,
        name,
        F.struct(
            *(F.col(f"{work}.{c}") for c in ("n_words", "n_dup_lines", "chars", "classes.*", "hits")),
            _covered_words(F.col(f"{work}.windows")).cast("long").alias("n_repeat_words"),
        ),
        [*docs.columns, ref],
    )
    of = lambda c: F.col(f"{name}.{c}")
    n_words = of("n_words")
    base_failed = (n_words < MIN_WORDS) | (100 * of("n_repeat_words") > MOST_REPEATED * n_words)
    told = F.coalesce(F.col(f"{ref}.reference_words") >= MIN_REFERENCE_WORDS, F.lit(False))
    char_distance = F.when(
        told & (of("chars") >= MIN_CHARS),
        distance(_with_rest([of(c) / of("chars") for c in _CLASSES]), F.col(f"{ref}.classes")),
    )
    per_word = F.transform(F.slice(of("hits"), F.lit(1), F.size(common)), lambda n: n.cast("double") / n_words)
    rest = F.aggregate(of("hits"), F.lit(0), lambda a, n: a + n)
    shares = F.concat(per_word, F.array((n_words - rest).cast("double") / n_words))
    word_distance = F.when(
        told & (n_words >= MIN_HISTOGRAM_WORDS) & common.isNotNull(),
        distance(shares, F.col(f"{ref}.shares")),
    )
    found = F.struct(
        n_words.alias("n_words"),
        (of("chars") - of("space")).alias("word_chars"),
        of("symbol").alias("n_symbols"),
        of("n_dup_lines").alias("n_dup_lines"),
        of("n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        char_distance.alias("char_distance"),
        word_distance.alias("word_distance"),
    )
    kept = (
        ~of("base_failed")
        & F.coalesce(of("char_distance") <= MOST_CHAR_DISTANCE, F.lit(True))
        & F.coalesce(of("word_distance") <= MOST_WORD_DISTANCE, F.lit(True))
    )
    return (
        measured.withColumn(name, found)
        .withColumn(name, F.struct(f"{name}.*", kept.alias("kept")))
        .select(*docs.columns, name)
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id`` of each row of ``docs (doc_id, lang, text)`` and what the rules find."""
    found = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"))
    return found.select("doc_id", *(f"rules.{c}" for c in _COUNTS), "rules.base_failed", "rules.kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    name = "_rules" + "_" * max(map(len, docs.columns))
    return judged(docs, name).where(F.col(f"{name}.kept")).select(*docs.columns)
