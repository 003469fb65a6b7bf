"""Numeric, character and drift profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions.labels import ctc_steps, ratio
from tierlens.operators.ranking import exact_quantiles
from tierlens.session import join_null_safe

PROFILE_QUANTILES = (0.01, 0.05, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9, 0.95, 0.99)   # fixed values


def quantile_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def numeric_profile(df: DataFrame, value: str, by: Sequence[str] = (), quantiles: Sequence[float] = PROFILE_QUANTILES) -> DataFrame:
    """Count, min, max, mean and linear-interpolation quantiles."""
    return exact_quantiles(df, value, {quantile_name(q): q for q in quantiles}, by)


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"))


def character_counts(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every character; the exploded characters meet their counts in the same task."""
    chars = df.select(*by, F.explode(F.split(F.col(text), "")).alias("character")).where(F.col("character") != "")
    return chars.groupBy(*by, "character").agg(F.count(F.lit(1)).alias("occurrences"))


def vocabulary_table(df: DataFrame, vocabulary: str) -> DataFrame:
    """The vocabulary (a fixed small set) as rows character, class_id."""
    spark = df.sparkSession
    return spark.createDataFrame([(c, k) for k, c in enumerate(vocabulary, 1)], "character string, class_id int")


def class_coverage(df: DataFrame, text: str, vocabulary: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every vocabulary character per group, zero where unseen."""
    found = character_counts(df, text, by)
    if not by:
        return vocabulary_table(df, vocabulary).join(found, "character", "left").select(
            "character", "class_id", F.coalesce("occurrences", F.lit(0)).alias("occurrences")
        )
    classes = F.array(*[F.struct(F.lit(c).alias("character"), F.lit(k).alias("class_id")) for k, c in enumerate(vocabulary, 1)])
    wanted = df.select(*by).distinct().select(*by, F.inline(classes))
    return join_null_safe(wanted, found, [*by, "character"], "left").select(
        *by, "character", "class_id", F.coalesce("occurrences", F.lit(0)).alias("occurrences")
    )


def drift(full: DataFrame, subset: DataFrame, dimensions: Sequence[str], limit: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Share of every value in the full table and in the subset, per group and dimension."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
        counts = df.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.dimension", "p.value").agg(F.count(F.lit(1)).alias(name))
        totals = counts.groupBy(*by, "dimension").agg(F.sum(name).alias("_t"))
        return join_null_safe(counts, totals, [*by, "dimension"]).withColumn(f"{name}_percent", F.lit(100.0) * F.col(name) / F.col("_t")).drop("_t")

    joined = join_null_safe(shares(full, "full"), shares(subset, "subset"), [*by, "dimension", "value"], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("subset", "subset_percent")})
    gap = F.abs(F.col("full_percent") - F.col("subset_percent"))
    return joined.select(
        *by, "dimension", "value", F.col("full").alias("full_count"), F.col("subset").alias("subset_count"),
        "full_percent", "subset_percent", gap.alias("difference_pp"), (gap > limit).alias("exceeds_limit"),
    )


def coverage_ratios(full: DataFrame, subset: DataFrame, text: str, vocabulary: str, minimum: int) -> DataFrame:
    """Per character: counts, ratios, normalised frequency ratio, effective minimum."""
    a = class_coverage(full, text, vocabulary).withColumnRenamed("occurrences", "full_count")
    b = class_coverage(subset, text, vocabulary).select("character", F.col("occurrences").alias("subset_count"))
    sums = a.join(b, "character")
    totals = sums.agg(F.sum("full_count").alias("f"), F.sum("subset_count").alias("s"))
    both = sums.withColumn("_t", totals.select(F.struct("f", "s")).scalar())
    full_share, sub_share = ratio(F.col("full_count"), F.col("_t.f")), ratio(F.col("subset_count"), F.col("_t.s"))
    return both.select(
        "character", "full_count", "subset_count",
        ratio(F.col("subset_count"), F.col("full_count")).alias("subset_full_ratio"),
        (100 * full_share).alias("full_percent"), (100 * sub_share).alias("subset_percent"),
        ratio(sub_share, full_share).alias("normalized_ratio"),
        F.least(F.lit(minimum), F.col("full_count")).alias("effective_minimum"),
    )


def prototypes(vectors: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """Mean vector per class, one pass with map-side partial sums."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)]
    return vectors.groupBy(label).agg(F.array(*means).alias("prototype"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_prototype(vectors: DataFrame, label: str, vector: str, dim: int, learned: DataFrame | None = None) -> DataFrame:
    """Cosine to the own class, to the best other class, their margin and the winner.

    Prototypes come from `learned` (label, vector), by default from the vectors themselves.

    Classes are the fixed symbol set, so all prototypes fit one array that is
    computed once and read by every row.
    """
    protos = prototypes(vectors if learned is None else learned, label, vector, dim)
    packed = protos.select(F.struct(F.col(label).alias("label"), F.col("prototype").alias("v"), F.sqrt(_dot(F.col("prototype"), F.col("prototype"))).alias("norm")).alias("p"))
    table = packed.agg(F.sort_array(F.collect_list("p")).alias("t")).scalar()
    norm = F.sqrt(_dot(F.col(vector), F.col(vector)))
    scores = F.transform("_protos", lambda p: F.struct((_dot(F.col(vector), p["v"]) / (F.col("_norm") * p["norm"] + 1e-12)).alias("cosine"), p["label"].alias("label")))
    scored = vectors.withColumn("_protos", table).withColumn("_norm", norm).withColumn("_scores", scores)
    own = F.get(F.filter("_scores", lambda s: s["label"] == F.col(label)), F.lit(0))["cosine"]
    other = F.array_max(F.transform(F.filter("_scores", lambda s: s["label"] != F.col(label)), lambda s: s["cosine"]))
    # the largest cosine, of equal ones the smallest label; labels are only compared
    best = F.array_min(F.transform("_scores", lambda s: F.struct((-s["cosine"]).alias("c"), s["label"].alias("label"))))
    return scored.select(
        *[c for c in vectors.columns if c != vector], own.alias("matched_cosine"), other.alias("best_other_cosine"),
        (own - other).alias("margin"), best["label"].alias("nearest_label"), (best["label"] == F.col(label)).alias("nearest_correct"),
    )


def ctc_feasibility(df: DataFrame, width: str, required: str, strides: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, stride, tiers, feasible, min_margin, failure_percent): whether widths give enough steps, per stride.

    The strides are expanded inside each row, and each task hands on one count per group and stride.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("stride"), (ctc_steps(F.col(width), s) - F.col(required)).alias("margin")) for s in strides])
    each = df.select(*by, F.explode(cells).alias("f")).select(*by, "f.stride", "f.margin")
    return each.groupBy(*by, "stride").agg(
        F.count(F.lit(1)).alias("tiers"), F.count_if(F.col("margin") >= 0).alias("feasible"), F.min("margin").alias("min_margin"),
        (F.lit(100.0) * F.count_if(F.col("margin") < 0) / F.count(F.lit(1))).alias("failure_percent"),
    )
