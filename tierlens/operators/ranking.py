"""Global and per-group ranks, quantiles and scans that no single task has to hold.

A window without partitions, or one over a hot key, sorts all of its rows in
one task.  Here every ordering is cut into buckets that follow the order
(a hash prefix, a day, a slice of the value range).  The window runs inside
the buckets; a small table of bucket totals carries the offsets across.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.functions.bind import let
from tierlens.session import join_null_safe, materialize

HASH_PREFIX = 3


def hash_bucket(hash_column: Column, prefix: int = HASH_PREFIX) -> Column:
    """Bucket of a hex hash; 16**prefix buckets of even size, in hash order."""
    return F.substr(hash_column, F.lit(1), F.lit(prefix))


def rank_within(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based row number per `by` group, ordered by `order`; `bucket` must follow it."""
    keyed = df.withColumn("_rank_bucket", bucket)
    sizes = keyed.groupBy(*by, "_rank_bucket").agg(F.count(F.lit(1)).alias("_rank_rows"))
    before = Window.partitionBy(*by).orderBy("_rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_rank_bucket", F.coalesce(F.sum("_rank_rows").over(before), F.lit(0)).alias("_rank_before"))
    inside = Window.partitionBy(*by, "_rank_bucket").orderBy(*order)
    return (
        join_null_safe(keyed.withColumn("_rank_inside", F.row_number().over(inside)), offsets, [*by, "_rank_bucket"])
        .withColumn(out, F.col("_rank_before") + F.col("_rank_inside"))
        .drop("_rank_bucket", "_rank_inside", "_rank_before")
    )


def piece_count(df: DataFrame) -> int:
    """Buckets for value ranges: a few per shuffle partition, at least 32, at most 1,024."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, min(1024, 4 * partitions))


def value_cuts(counts: DataFrame, value: str, pieces: int) -> Column:
    """Approximate cut points of a value as struct<fine, coarse>, taken once from the data.

    `fine` holds all cuts in order, `coarse` every step-th of them, with a step
    near the square root of their number.  Rough cuts are enough: they only
    shape the buckets.
    """
    probs = [k / pieces for k in range(1, pieces)]
    step = cut_step(pieces)
    fine = counts.agg(F.array_distinct(F.percentile_approx(value, probs, 4 * pieces)).alias("fine"))
    coarse = F.filter("fine", lambda c, i: i % step == step - 1)
    return fine.select(F.struct("fine", coarse.alias("coarse")).alias("c")).scalar()


def cut_step(pieces: int) -> int:
    return max(2, round(pieces**0.5))


def cuts_below(cuts: Column, value: Column, pieces: int) -> Column:
    """Number of cuts below a value, looked up in two short steps instead of one long scan."""
    step = cut_step(pieces)
    passed = F.size(F.filter(cuts["coarse"], lambda c: c < value)) * step
    rest = lambda start: start + F.size(F.filter(F.slice(cuts["fine"], start + 1, F.lit(step)), lambda c: c < value))
    return let(passed, rest)


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """Distinct values per group with their count and the rows before them, in value order.

    Equal values are merged before anything is ordered, so a value that holds
    a third of the rows is one row here.  The counts are written: cuts, bucket
    totals and places all read them.
    """
    pieces = pieces or piece_count(df)
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows")), "counts")
    keyed = counts.withColumn("_cuts", value_cuts(counts, value, pieces)).select(
        *by, value, "rows", cuts_below(F.col("_cuts"), F.col(value), pieces).alias("_bucket")
    )
    totals = keyed.groupBy(*by, "_bucket").agg(F.sum("rows").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("group_rows"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_null_safe(keyed.withColumn("_inside", F.coalesce(F.sum("rows").over(inside), F.lit(0))), offsets, [*by, "_bucket"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )


def _value_at(value: str, position: Column) -> Column:
    """Value holding the 0-based position of its group (aggregate expression)."""
    hit = (F.col("before") <= position) & (position < F.col("before") + F.col("rows"))
    return F.max(F.when(hit, F.col(value)))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles at (n-1)*q per group, plus count, min, max, mean."""
    ranked = cumulative_counts(df, value, by)
    parts = [
        F.max("group_rows").alias("rows"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("rows")) / F.max("group_rows")).alias("mean"),
    ]
    places = {name: (F.col("group_rows") - 1) * F.lit(float(q)) for name, q in probs.items()}
    for name, pos in places.items():
        parts += [
            _value_at(value, F.floor(pos)).cast("double").alias(f"_lo_{name}"),
            _value_at(value, F.ceil(pos)).cast("double").alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    wide = ranked.groupBy(*by).agg(*parts)
    values = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs
    ]
    return wide.select(*by, "rows", "min", "max", "mean", *values)


def order_statistic(df: DataFrame, value: str, fraction: float, by: Sequence[str] = (), minimum: int = 0) -> DataFrame:
    """Value at sorted position min(int(n*fraction), n-1) per group.

    A value that is not finite stops the job, and so does a group of fewer
    than `minimum` values; nulls are not counted.
    """
    number = F.col(value).cast("double")
    odd = F.isnan(number) | (F.abs(number) == float("inf"))
    finite = df.withColumn(value, F.when(odd, F.raise_error(F.lit(f"{value} is not finite"))).otherwise(F.col(value)))
    ranked = cumulative_counts(finite if minimum else df, value, by)
    position = F.least(F.floor(F.col("group_rows") * F.lit(float(fraction))), F.col("group_rows") - 1)
    found = ranked.groupBy(*by).agg(F.max("group_rows").alias("rows"), _value_at(value, position).alias("threshold"))
    few = F.concat(F.lit("too few values: "), F.col("rows").cast("string"))
    return found.withColumn("threshold", F.when(F.col("rows") < minimum, F.raise_error(few)).otherwise(F.col("threshold"))) if minimum else found


def previous_row(
    df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], columns: Sequence[str], out: str = "prev"
) -> DataFrame:
    """Struct of `columns` of the preceding row per group (lag across ordered buckets)."""
    packed, key = F.struct(*columns), F.struct(*order)
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    last = df.groupBy(*by, bucket).agg(F.max_by(packed, key).alias("_scan_last"))
    carry = last.select(*by, bucket, F.lag("_scan_last").over(Window.partitionBy(*by).orderBy(bucket)).alias("_scan_carry"))
    return (
        join_null_safe(df.withColumn("_scan_prev", F.lag(packed).over(inside)), carry, [*by, bucket])
        .withColumn(out, F.coalesce("_scan_prev", "_scan_carry"))
        .drop("_scan_prev", "_scan_carry")
    )


def running_sum(
    df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Inclusive running sum per group across ordered buckets."""
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_scan_total"))
    offsets = totals.select(*by, bucket, F.coalesce(F.sum("_scan_total").over(earlier), F.lit(0)).alias("_scan_offset"))
    return (
        join_null_safe(df.withColumn("_scan_inside", F.sum(value).over(inside)), offsets, [*by, bucket])
        .withColumn(out, F.col("_scan_inside") + F.col("_scan_offset"))
        .drop("_scan_inside", "_scan_offset")
    )


def numbered_runs(
    df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], columns: Sequence[str],
    opens: Callable[[Column, Column], Column], counts: Column | None = None,
) -> DataFrame:
    """Adds `place` and `run` (both from 1) of every row of its group, and `counted`, the runs up to its own for which `counts` holds.

    `opens(previous, row)` says whether a row starts a run, given structs of
    `columns`; null starts one.  One exchange by group and bucket carries
    the rows: lag, row number and running counts are windows over it, and one
    boundary row per bucket, taken from the same exchange, carries places and
    runs across buckets.
    """
    counts = F.lit(True) if counts is None else counts
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    opened = lambda before, now: F.when(before.isNull(), 1).otherwise(F.coalesce(opens(before, now).cast("int"), F.lit(1)))
    marked = (
        df.withColumn("_now", F.struct(*columns)).withColumn("_counts", F.coalesce(counts, F.lit(False)).cast("int"))
        .withColumn("_before", F.lag("_now").over(inside)).withColumn("_at", F.row_number().over(inside))
        .withColumn("_open", F.when(F.col("_at") == 1, 0).otherwise(opened(F.col("_before"), F.col("_now"))))
        .withColumn("_runs", F.sum("_open").over(upto)).withColumn("_counted", F.sum(F.col("_open") * F.col("_counts")).over(upto))
    )
    edges = marked.groupBy(*by, bucket).agg(
        F.max("_at").alias("_rows"), F.max("_runs").alias("_inner"), F.max("_counted").alias("_inner_counted"),
        F.min_by("_now", "_at").alias("_first"), F.max_by("_now", "_at").alias("_last"), F.min_by("_counts", "_at").alias("_first_counts"),
    )
    line = Window.partitionBy(*by).orderBy(bucket)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    headed = edges.withColumn("_end", F.lag("_last").over(line)).withColumn("_head", opened(F.col("_end"), F.col("_first")))
    head_counted = F.col("_head") * F.col("_first_counts")
    sum_before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = headed.select(
        *by, bucket, sum_before(F.col("_rows")).alias("_place0"), (sum_before(F.col("_head") + F.col("_inner")) + F.col("_head")).alias("_run0"),
        (sum_before(head_counted + F.col("_inner_counted")) + head_counted).alias("_counted0"),
    )
    return join_null_safe(marked, offsets, [*by, bucket]).select(
        *[F.col(c) for c in df.columns], (F.col("_place0") + F.col("_at")).alias("place"), (F.col("_run0") + F.col("_runs")).alias("run"),
        (F.col("_counted0") + F.col("_counted")).alias("counted"),
    )


def top_examples(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """At most k rows per group in a total order (the rank limit runs before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("example_rank", F.row_number().over(w)).where(F.col("example_rank") <= k)
