"""Mixing sources to target weights by entropy balancing.

Rates of use r of documents are sought that are as near to 1 as can be in relative entropy,
at most 2, and use the target number of words of every source. The dual has one multiplier
for each source: r = min(2, exp(m * size)). It is convex; guarded Newton iterations solve it
for all sources at once. As a rate depends on source and size only, they run over a table
with a row for each source and size. Rates are then rounded to copies so that the rounding
errors of a source cancel along its sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envtally.llm.storage import written
from envtally.operators.ordering import with_position

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Words by which a solved source may miss its target before rounding.
TOLERANCE = 0.25
MAX_ROUNDS = 100
#: Rounds that move what rounding has left over.
SETTLING_ROUNDS = 6
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null.

    Words begin where a word character follows the start or a space, so both are counted.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """``sources (source, size)`` with ``target``: words to take from each.

    Sources in code point order, null last, weigh WEIGHTS in turn and share SHARE times all
    words; a target stops at MOST times its source's words, and the excess is shared anew
    by weight until none is above.
    """
    keyed = sources.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull().cast("int")})
    placed = with_position(written(keyed), ["_all"], ["_null", "source"], "_place")
    turn = F.pmod(F.col("_place") - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int"))
    weighed = written(placed.select("source", "size", weight.alias("weight")))
    most = F.col("size").cast("double") * MOST
    total = weighed.agg(F.sum("size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        is_stopped = F.col("weight") * level >= most
        free = F.sum(F.when(~is_stopped, F.col("weight")))
        n, taken, weights = weighed.agg(
            F.count_if(is_stopped), F.sum(F.when(is_stopped, most)), free
        ).first()
        if n == stopped or not weights:
            break
        stopped, level = n, (SHARE * total - (taken or 0.0)) / weights
    target = F.least(F.col("weight") * F.lit(level), most) if weights else most
    return weighed.withColumn("target", target).drop("weight")


def balance(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``cells (source, size, n)`` with ``rate``, given ``sources (source, size, target)``.

    The multiplier is that of sizes divided by the mean size of the source's words. A source
    whose target is all it can give has rate MOST throughout. Each round is checkpointed. That
    a source is still off its target after MAX_ROUNDS is an error.
    """
    known = sources.select("source", F.col("target").alias("goal"), F.col("size").alias("total"))
    state = written(
        known.withColumns(
            {
                "m": F.lit(0.0),
                "low": F.lit(float("-inf")),
                "high": F.lit(float("inf")),
                "open": (F.col("total") > 0) & (F.col("goal") < F.col("total") * MOST * (1 - 1e-12)),
            }
        )
    )
    cells = cells.where("size > 0")
    spread = cells.join(
        cells.groupBy(F.col("source").alias("_s"))
        .agg((_sum(F.col("n") * F.col("size").cast("double") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean")),
        F.col("source").eqNullSafe(F.col("_s")),
    ).drop("_s")
    spread = written(spread)
    for _ in range(MAX_ROUNDS):
        if not state.where("open").limit(1).count():
            break
        state = written(_newton(spread, state))
    else:
        if not state.where("open").isEmpty():
            raise RuntimeError(f"sources off their targets after {MAX_ROUNDS} rounds")
    solved = state.select(
        F.col("source").alias("_s"), F.when(F.col("goal") < F.col("total") * MOST * (1 - 1e-12), F.col("m")).alias("m")
    )
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("m").isNull(), F.lit(float(MOST))).otherwise(_rate(F.col("m"), x))
    return spread.join(solved, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "n", rate.alias("rate")
    )


def _sum(value: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def _rate(m: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(m * x, F.lit(1.0))))


def _newton(spread: DataFrame, state: DataFrame) -> DataFrame:
    """One step for every open source, held inside the bracket of what is known to be too
    low and too high. An open source misses its goal by more than TOLERANCE words."""
    mine = state.where("open").withColumnRenamed("source", "_s")
    x = F.col("size") / F.col("mean")
    words, rate = F.col("n") * F.col("size"), _rate(F.col("m"), x)
    taken, slope = _sum(words * rate), _sum(F.when(rate < MOST, words * rate * x))
    measured = (
        spread.join(mine, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy(F.col("source").alias("_s"))
        .agg(taken.alias("taken"), F.nullif(slope, F.lit(0.0)).alias("slope"))
    )
    miss = F.col("taken") - F.col("goal")
    missed = F.coalesce(F.abs(miss) > TOLERANCE, F.lit(False))
    low = F.when(miss < 0, F.col("m")).otherwise(F.col("low"))
    high = F.when(miss > 0, F.col("m")).otherwise(F.col("high"))
    # Newton on the logarithm of the words taken, which is nearly straight.
    step = F.col("m") - F.col("taken") / F.col("slope") * F.log(F.col("taken") / F.col("goal"))
    middle = (
        F.when(F.col("_low") == float("-inf"), F.col("_high") * 2 - 1)
        .when(F.col("_high") == float("inf"), F.col("_low") * 2 + 1)
        .otherwise((F.col("_low") + F.col("_high")) / 2)
    )
    good = (F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high"))
    return (
        state.join(measured, F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumns({"_missed": F.col("open") & missed, "_low": low, "_high": high, "_step": step})
        .withColumn("_stuck", F.coalesce(F.col("_high") - F.col("_low") <= F.abs(F.col("m")) * 1e-15, F.lit(False)))
        .select(
            "source", "goal", "total",
            F.when(F.col("_missed"), F.when(F.coalesce(good, F.lit(False)), F.col("_step")).otherwise(middle))
            .otherwise(F.col("m")).alias("m"),
            F.when(F.col("_missed"), F.col("_low")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("_missed"), F.col("_high")).otherwise(F.col("high")).alias("high"),
            (F.col("_missed") & ~F.col("_stuck")).alias("open"),
        )
    )


def rounded(cells: DataFrame) -> DataFrame:
    """``cells (source, size, n, rate)`` with ``copies``: those of all its documents together.

    Along a source, by falling size, the copies up to a size are the rates up to it, rounded,
    so that what is rounded away at one size comes back at the next. Sizes of a source run
    up to its longest text; its rates are summed up over ranges of sizes first, and no
    window is larger than the number of ranges or the sizes of one.
    """
    ranged = cells.withColumns(
        {"_range": F.floor(F.log2("size") * 64), "_mass": (F.col("n") * F.col("rate")).cast("decimal(30,9)")}
    )
    sums = ranged.groupBy("source", "_range").agg(F.sum("_mass").alias("_sum"))
    above = Window.partitionBy("source").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("source", "_range").orderBy(F.desc("size"))
    upto = F.col("_before") + F.sum("_mass").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranged.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_upto", F.round(upto).cast("long"))
        .withColumn("_last", F.round(F.col("_before")).cast("long"))
        .withColumn("copies", F.col("_upto") - F.coalesce(F.lag("_upto").over(inside), F.col("_last")))
        .select("source", "size", "n", "rate", F.least(F.col("copies"), F.col("n") * MOST).alias("copies"))
    )


def settled(cells: DataFrame) -> DataFrame:
    """``cells (source, size, n, copies, target)`` with copies moved towards the target.

    What rounding has left over or lacking is less than the longest text. In each round a
    source takes more, or fewer, copies of the largest size that still fits into the rest.
    """
    cells = written(cells)
    for _ in range(SETTLING_ROUNDS):
        taken = F.sum(F.col("copies") * F.col("size"))
        rests = cells.groupBy(F.col("source").alias("_s")).agg(
            F.round(F.max("target") - taken).cast("long").alias("_rest")
        )
        measured = cells.join(rests, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        room = F.when(F.col("_rest") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_rest")) & (room > 0)
        measured = written(measured.withColumns({"_room": room, "_fits": fits}))
        best = measured.where("_fits").groupBy(F.col("source").alias("_s")).agg(F.max("size").alias("_z"))
        moved = F.least(F.col("_room"), F.floor(F.abs("_rest") / F.col("size"))) * F.signum(F.col("_rest").cast("double"))
        here = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
        changed = measured.join(best, here, "left")
        if not measured.where("_fits").limit(1).count():
            break
        cells = changed.withColumn(
            "copies", F.col("copies") + F.when(F.col("_z").isNotNull(), moved).otherwise(0).cast("long")
        ).select("source", "size", "n", "copies", "target")
    return cells


def mix(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, source, size, source_size, target, copies, taken`` of each row of ``docs``.

    ``docs`` has ``source`` and ``text``, and ``keys`` that tell rows apart. size counts the
    words of the text, 0 for null; taken is copies * size, and copies is 0 to MOST. The
    documents of one source and size share their copies as evenly as whole numbers can, the
    odd ones going by a hash of the keys, so reruns agree. A document without words has one
    copy, of no words. Sources compare null-safe; a null source is a source. An empty table
    gives an empty result.
    """
    rows = written(docs.select(*keys, "source", word_count(F.col("text")).alias("size")))
    return _mixed(rows, keys)


def repeat(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, source, text`` and others) with each row as often as ``mix`` takes it.

    The columns are those of ``docs``. A document without words stays once. Rows that share
    doc_id, source and text share their copies, the first ones taking the odd ones.
    """
    tail = "_" * max(map(len, docs.columns))
    hash_, total, many, copies = (f"_{n}{tail}" for n in ("hash", "total", "many", "copies"))
    text_hash = F.xxhash64("text")
    rows = written(
        docs.select("doc_id", text_hash.alias("text_hash"), "source", word_count(F.col("text")).alias("size"))
    )
    sums = (
        _mixed(rows, ("doc_id", "text_hash"))
        .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("source").alias("_s"))
        .agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(many))
    )
    keyed = docs.withColumn(hash_, text_hash)
    pairs = {"doc_id": "_d", hash_: "_h", "source": "_s"}
    same = [keyed[ours].eqNullSafe(F.col(theirs)) for ours, theirs in pairs.items()]
    joined = keyed.join(written(sums), same[0] & same[1] & same[2])
    alone = joined.where(F.col(many) == 1).withColumn(copies, F.col(total))
    number = F.row_number().over(Window.partitionBy("_d", "_h", "_s").orderBy("_h"))
    each = F.floor(F.col(total) / F.col(many))
    shared = joined.where(F.col(many) > 1).withColumn(
        copies, each + (number <= F.col(total) - each * F.col(many)).cast("long")
    )
    both = alone.unionByName(shared).where(F.col(copies) > 0)
    times = F.sequence(F.lit(1).cast("long"), F.col(copies))
    return both.withColumn(copies, F.explode(times)).select(*docs.columns)


def _mixed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    sources = written(targets(sums))
    balanced = rounded(balance(cells, sources)).join(
        sources.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))
    )
    copies = settled(balanced.select("source", "size", "n", "copies", "target"))
    share = _keyed(cells).drop("source").join(
        _keyed(copies).select("_key", "size", "copies"), ["_key", "size"], "left"
    )
    share = share.join(
        _keyed(sources).select("_key", F.col("size").alias("source_size"), "target"), "_key"
    )
    # A cell may hold a third of all documents: its parts go to different tasks.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = _keyed(rows).withColumn("_hash", F.xxhash64(*keys))
    hashed = hashed.withColumn("_part", F.pmod("_hash", F.lit(parts)))
    cell = ["_key", "size", "_part"]
    earlier = Window.partitionBy("_key", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_count"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    known = written(offsets.drop("_count").join(share, ["_key", "size"]))
    # Any fixed order of a cell's documents will do; in this one, the first have the odd copies.
    inside = Window.partitionBy(*cell).orderBy("_hash", *keys)
    each = F.floor(F.col("copies") / F.col("n"))
    odd = F.col("copies") - each * F.col("n")
    number = each + (F.col("_rank") + F.col("_before") <= odd).cast("long")
    return (
        hashed.join(known, cell)
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("copies", F.coalesce(number, F.lit(1)).cast("long"))
        .select(*keys, "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def _keyed(df: DataFrame) -> DataFrame:
    """With the source as a key that is not null."""
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
