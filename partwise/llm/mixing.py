"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Each source is dealt into blocks of rows. With its weight as a whole number a of A (the sum of all), its block k (from 0) has the pseudo-release
floor(k * A / a) and the pseudo-deadline ceil((k + 1) * A / a). In each slot of the schedule the released block with the
earliest deadline goes next (on a tie the source that comes first by name). Since the weights sum to one, every block
keeps its window, so after any number of slots a source is less than one block away from its share, whatever the number of slots and
of sources. Weights are rounded to 10**-9 of their sum, 10**-9 at least; given in such steps they are exact.

The schedule is made by segments that know nothing of each other. From a state in which each source has given floor or ceil of its share,
the next blocks by deadline first, the deadlines after it can be kept; and two such schedules are the same once the deadlines of all blocks
in which they differ have passed, which is when the longest window has passed. So each segment begins one longest window early, in that
state, and its own slots are those of the schedule from slot 0. A segment is as long as the longest window (and SEGMENT at least), so half
of all work is this run-up at most. Only numbers of blocks are scheduled, one for block_rows rows.

The mixture ends with the deadline by which every source has given each of its blocks once; a source that is done earlier starts
again (epoch 1, 2, ...). No row is left out, and shares are right over the whole mixture. A source's rows are
ordered by a hash. Ranks come from counts of hash buckets (pre-aggregated) and row numbers within buckets, so a source
with most of the rows is never in one task. Each bucket is told the slots of its blocks, so rows are shuffled once.

Defined results: a null source is a source of its own; repeated rows are all kept (rows equal in every column share a bucket); an empty table
gives an empty mixture; null or long texts don't matter; further columns are carried along. A source without a weight, or with one that
isn't above 0, raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import put_back, set_aside, staged

UNIT, SEGMENT, BLOCK_ROWS, TEMPERATURE = 10**9, 1024, 32, 0.9
#: A segment's order is collected by pieces of so many slots.
PIECE = 64


def tempered(sizes: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """(source, n, weight): weights in proportion to a power of the sizes."""
    return sizes.withColumn("weight", F.pow("n", F.lit(power)))


def _key(source: str | Column) -> Column:
    """The source as a text that isn't null, so that windows and joins on it share one shuffle."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shares(weighted: DataFrame) -> DataFrame:
    """(key, n, a) of weighted (key, n, weight): a is the weight in billionths of the sum, 1 at least."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())  # one row for each source
    sound = F.when(F.col("weight") > 0, share).otherwise(F.raise_error(F.concat(F.lit("no weight above 0 for the source "), "key")).cast("double"))
    return weighted.select("key", "n", F.greatest(F.lit(1).cast("long"), F.round(sound * UNIT).cast("long")).alias("a"))


def _down(x: Column, y: Column) -> Column:
    """x / y of whole numbers, rounded down."""
    return F.call_function("div", x, y)


def _up(x: Column, y: Column) -> Column:
    return _down(x + y - 1, y)


def _state(a: Column, all_: Column, slot: Column) -> Column:
    """Blocks given by each source before the slot: floor of the share, and one more where the deadline of the next block, if it is
    released, is among the earliest, as many as make the sum the slot."""
    low = F.transform(a, lambda w: _down(w * slot, all_))
    begun = F.filter(
        F.transform(F.arrays_zip(a.alias("a"), low.alias("k")), lambda x, i: F.when((x["a"] * slot) % all_ > 0, F.struct(_up((x["k"] + 1) * all_, x["a"]).alias("deadline"), i.alias("i")))),
        lambda x: x.isNotNull(),
    )
    open_ = slot - F.aggregate(low, F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.transform(F.slice(F.array_sort(begun), F.lit(1), open_.cast("int")), lambda x: x["i"])
    return F.transform(low, lambda k, i: k + F.array_contains(first, i).cast("long"))


def _run(state: Column, from_: Column, to: Column, a: Column, all_: Column) -> Column:
    """Earliest deadline first through the slots from_ .. to - 1: done, and order, the source's index (from 0) and the block's number for each slot."""

    def step(s: Column, slot: Column) -> Column:
        released = F.transform(
            F.arrays_zip(a.alias("a"), s["done"].alias("k")),
            lambda x, i: F.when(_down(x["k"] * all_, x["a"]) <= slot, F.struct(_up((x["k"] + 1) * all_, x["a"]).alias("deadline"), i.alias("i"), x["k"].alias("k"))),
        )
        # through an array of one, so that the choice is made once and used twice
        return F.transform(
            F.array(F.array_min(released)),
            lambda x: F.struct(
                F.transform(s["done"], lambda k, j: k + (j == x["i"]).cast("int")).alias("done"), F.concat(s["order"], F.array(F.struct(x["i"].alias("i"), x["k"].alias("k")))).alias("order")
            ),
        )[0]

    return F.aggregate(F.sequence(from_, to - 1), F.struct(state.alias("done"), F.array().cast("array<struct<i:int,k:bigint>>").alias("order")), step)


def schedule(sources: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(key, k, slot, release, deadline) of the blocks in the mixture's slots, from sources (key, blocks, a)."""
    told = sources.agg(F.array_sort(F.collect_list(F.struct("key", "a", "blocks"))).alias("s")).where(F.size("s") > 0)  # one entry for each source
    told = told.select("s", F.transform("s", lambda x: x["a"]).alias("a"), F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["a"]).alias("all"))
    a, all_, first = F.col("a"), F.col("all"), F.col("first")
    told = told.withColumns({
        "length": F.array_max(F.transform("s", lambda x: _up(x["blocks"] * all_, x["a"]))),
        "window": _up(all_, F.array_min("a")) + 1,
    }).withColumn("size", F.greatest(F.lit(segment).cast("long"), "window"))
    parts = told.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.col("size")))).repartition("first")
    parts = parts.withColumns({"from": F.greatest(first - F.col("window"), F.lit(0).cast("long")), "to": F.least(first + F.col("size"), "length")})

    def piece(s: Column, at: Column) -> Column:
        end = F.least(at + PIECE, F.when(at < first, first).otherwise(F.col("to")))
        return F.transform(
            F.array(_run(s["done"], at, end, a, all_)),
            lambda r: F.struct(r["done"].alias("done"), F.when(at < first, s["orders"]).otherwise(F.concat(s["orders"], F.array(r["order"]))).alias("orders")),
        )[0]

    # the run-up, whose order isn't needed, then the segment's own slots; by pieces, so that no long array is copied at each step
    begins = lambda x, y: F.when(x < y, F.sequence(x, y - 1, F.lit(PIECE).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(_state(a, all_, F.col("from")).alias("done"), F.array().cast("array<array<struct<i:int,k:bigint>>>").alias("orders"))
    made = F.aggregate(F.concat(begins(F.col("from"), first), begins(first, F.col("to"))), start, piece, lambda s: F.flatten(s["orders"]))
    own = parts.select("s", "all", "first", F.posexplode(made).alias("at", "x")).withColumn("own", F.element_at("s", F.col("x.i") + 1))
    k, w = F.col("x.k"), F.col("own.a")
    return own.select(F.col("own.key").alias("key"), k.alias("k"), (first + F.col("at")).alias("slot"), _down(k * all_, w).alias("release"), _up((k + 1) * all_, w).alias("deadline"))


def ranked(rows: DataFrame, most: int, per_bucket: int = 1024) -> tuple[DataFrame, DataFrame]:
    """rows with _key, _bucket and _rank (from 1, in the bucket), and the buckets (_key, _bucket, _before, _n): how many rows of the source
    come before them, and have them. A source's rows are in the order of a hash of all columns.

    Buckets are the hash's leading bits, so many that the largest source, of `most` rows, has about per_bucket rows in each.
    """
    names = rows.columns
    bits = min(31, max(0, (max(most, 1) - 1).bit_length() - (per_bucket - 1).bit_length()))
    bucket = F.shiftright(F.shiftright("_hash", 32).cast("long") + (1 << 31), 32 - bits)
    hashed = rows.withColumn("_hash", F.xxhash64(*names)).withColumn("_bucket", bucket).withColumn("_key", _key("source"))
    sizes = hashed.groupBy("_key", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n")
    within = Window.partitionBy("_key", "_bucket").orderBy("_hash", *[c for c in names if c != "source"])
    return hashed.withColumn("_rank", F.row_number().over(within)).drop("_hash"), buckets


def mixed(rows: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, segment: int = SEGMENT) -> DataFrame:
    """rows with block (of its source), epoch, slot (of its block in the mixture), release, deadline and nth (in its block).

    weights: (source, weight) of the rows' sources; tempered() if none are given. Order the result by slot and nth. Columns of
    rows with these names are replaced.
    """
    rows, carried = set_aside(rows, "source")
    names = rows.columns
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = tempered(sizes).withColumn("key", _key("source"))
    else:
        given = weights.select(_key("source").alias("key"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.withColumn("key", _key("source")).join(given, "key", "left")
    sources = staged(shares(weighted).withColumn("blocks", F.ceil(F.col("n") / block_rows)))
    plan = staged(schedule(sources, segment)).join(sources.select("key", "blocks"), "key")
    plan = plan.select(F.col("key").alias("_key"), (F.col("k") % F.col("blocks")).alias("block"), F.struct(_down(F.col("k"), F.col("blocks")).alias("epoch"), "slot", "release", "deadline").alias("x"))
    own, buckets = ranked(rows, sources.agg(F.max("n")).first()[0] or 0)
    # each bucket with the slots of all epochs of the blocks that it has rows of
    last = _down(F.col("_before") + F.col("_n") - 1, F.lit(block_rows))
    holds = buckets.select("_key", "_bucket", "_before", F.explode(F.sequence(_down(F.col("_before"), F.lit(block_rows)), last)).alias("block"))
    told = holds.join(plan, ["_key", "block"]).groupBy("_key", "_bucket").agg(F.first("_before").alias("_before"), F.collect_list(F.struct("block", "x")).alias("_slots"))
    placed = own.join(told, ["_key", "_bucket"]).withColumn("_nth", F.col("_before") + F.col("_rank") - 1)
    placed = placed.withColumn("block", _down(F.col("_nth"), F.lit(block_rows)))
    placed = placed.withColumn("_at", F.explode(F.filter("_slots", lambda x: x["block"] == F.col("block"))))
    placed = placed.select(*names, "block", *[F.col(f"_at.x.{c}").alias(c) for c in ("epoch", "slot", "release", "deadline")], (F.col("_nth") % block_rows).alias("nth"))
    return put_back(placed, carried, "block", "epoch", "slot", "release", "deadline", "nth")
