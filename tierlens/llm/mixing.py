"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.llm.common import free_name, id_text, quoted, shuffled, task_count, word_count, written

#: A document is taken this many times at most.
REPEATS = 3
#: Weights go round over the sources in order.
WEIGHTS = (1, 2, 3)
#: Rows per slice of a source's queue; only shapes tasks.
SLICE_ROWS = 200_000
#: Finish times from here on share one range; the budget ends near finish time 1.
LATE = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The sources by code point, null last, weigh `weights` in turn and share
    the total of all sizes.  A target stops at `repeats` times its source's
    size; what that leaves over goes to the others by weight until none is
    above.  In the order of size per weight the stopped sources come first, so
    the level of the rest is found by sums along that order instead of rounds.
    One row per source passes through one task.
    """
    line = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int"))
    limited = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("limit"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = limited.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))).alias("left_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("left_weight"),
        F.row_number().over(filling).alias("place"),
    )
    stops = F.col("limit") * F.col("left_weight") <= F.col("left_size") * F.col("weight")
    # the first source in this order that doesn't stop sets the level for itself and all behind it
    level = F.min(F.when(~stops, F.struct("place", "left_size", "left_weight"))).over(everything)
    shared = F.col("level.left_size") * F.col("weight") / F.col("level.left_weight")
    return rest.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("place") >= F.col("level.place"), shared).otherwise(F.col("limit").cast("double")).alias("target"),
    )


def _queue_key() -> Column:
    """Shuffled place of a document in its source's queue: a hash of its id."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_text(F.col("doc_id")), F.lit(""))))


def _slice(key: Column, slices: int) -> Column:
    """Slice of the queue, in the order of the key."""
    return F.floor(F.conv(F.substr(key, F.lit(1), F.lit(8)), 16, 10).cast("long") * slices / F.lit(float(1 << 32))).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken, row) per row of `docs` (columns doc_id, source, text).

    `row` names a column that numbers the rows; without it they are numbered here.

    Weighted fair queueing.  Each source's documents stand in a queue shuffled
    by a hash of doc_id, and the queue is gone through `repeats` times.  A
    copy's virtual finish time is its source's words up to and with it,
    divided by the source's target.  All copies are put in the order of finish
    time and taken until the next one would pass the budget, the total of all
    sizes.  `times` counts a document's copies in the mix, `taken` their words.

    Size is the number of words between ASCII white space; a null or empty
    text has size 0 and is taken 0 words.  Null is a source like any other,
    the last.  Rows with equal or null ids keep the order of their sizes, so
    reruns agree.  An empty table gives an empty one.

    Queues are cut into slices of the hash, so a hot source is many tasks;
    only totals per source and slice, and per range of finish time, are
    gathered.  The ranges are equal in virtual time, which by the method holds
    about equal words in each.
    """
    spark = docs.sparkSession
    number = F.col(quoted(row)) if row else F.monotonically_increasing_id()
    narrow = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _queue_key().alias("key"), number.alias("row")),
        "mix-sizes",
    )
    rows = narrow.count()
    slices = max(task_count(spark), rows // SLICE_ROWS + 1)
    queue = narrow.withColumn("slice", _slice(F.col("key"), slices))
    parts = written(queue.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    shares = written(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats), "mix-targets")
    # totals per source and slice: running sums over slices, not over documents
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("head"))
    heads = heads.join(
        shares.select(F.col("source").alias("t_source"), "source_size", "target"), F.col("s_source").eqNullSafe(F.col("t_source"))
    ).drop("t_source")
    inside = Window.partitionBy("source", "slice").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        queue.withColumn("inside", F.sum("size").over(inside))
        .join(shuffled(heads), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .select("doc_id", "source", "size", "row", "key", "source_size", "target", (F.col("head") + F.col("inside")).alias("upto"))
    )
    queued = written(queued, "mix-queue")
    finish = (F.col("upto") + F.col("round") * F.col("source_size")) / F.col("target")
    copies = (
        queued.where((F.col("size") > 0) & (F.col("target") > 0))
        .select("row", "key", "source", "size", "upto", "source_size", "target", F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("round"))
        .withColumn("finish", finish).withColumn("range", F.least(F.floor(F.col("finish") * slices).cast("long"), F.lit(LATE * slices).cast("long")))
    )
    # a whole range fits or not by its total; only the range in which the budget ends is put in order copy by copy
    budget = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running))
    over = ranges.where(F.col("upto") > budget).orderBy("range").first()
    if over is None:
        taken = copies
    else:
        line = Window.orderBy("finish", F.col("source").isNull(), "source", "round", "key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("range") == over["range"]).withColumn("running", F.sum("size").over(line) + F.lit(over["upto"] - over["words"]))
        taken = copies.where(F.col("range") < over["range"]).select("row").unionAll(edge.where(F.col("running") <= budget).select("row"))
    times = taken.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    return (
        queued.join(times, "row", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"), "row")
        .withColumn("taken", F.col("times") * F.col("size"))
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """`docs` as the mix takes them: each row as often as it is taken, none that isn't.

    Rows without words weigh nothing and stay, once.
    """
    row, times = free_name(docs, "row_place"), free_name(docs, "mix_times")
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    taken = mix(placed, weights, repeats, row).select(
        F.col("row").alias(row), F.when(F.col("size") == 0, 1).otherwise(F.col("times").cast("int")).alias(times)
    )
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return placed.join(taken.where(F.col(times) > 0), row).select(*[F.col(quoted(c)) for c in docs.columns], copies.alias(times)).drop(times)
