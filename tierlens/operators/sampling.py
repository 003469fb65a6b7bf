"""Deterministic, group-aware splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.functions.hashing import hash_rank, tagged_hash
from tierlens.operators.ranking import hash_bucket, rank_within
from tierlens.session import join_null_safe, materialize

SPLIT_NAMES = ("protected_test", "validation_calibration", "development_design")


# -- W1 quantile buckets -----------------------------------------------------

def quantile_cuts(df: DataFrame, value: str, buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """Kept cut points of a whole-number column per group, as one sorted array.

    The column is reduced to value counts first; their number is bounded by the
    value range.  Cuts that leave the same rows on the left, or none on either
    side, are merged.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    probs = [i / buckets for i in range(1, buckets)]
    proposed = counts.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs]), F.col("_n")).alias("_p"))
    joined = counts.join(F.broadcast(proposed), list(by)) if by else counts.withColumn("_p", proposed.select("_p").scalar())
    left = [
        F.coalesce(F.sum(F.when(F.col(value) <= F.get("_p", F.lit(i)), F.col("_n"))), F.lit(0)) for i in range(len(probs))
    ]
    measured = joined.groupBy(*by).agg(F.first("_p").alias("_p"), F.sum("_n").alias("_all"), F.array(*left).alias("_left"))
    fresh = lambda n, i: (n > 0) & (n < F.col("_all")) & (F.array_position("_left", n) == i + 1)
    flagged = F.transform("_left", lambda n, i: F.when(fresh(n, i), F.get("_p", i)))
    return measured.select(*by, F.array_compact(flagged).alias("cuts"))


def bucket_of(value: Column, cuts: Column) -> Column:
    """1-based bucket: values up to and including a cut stay left of it."""
    return F.size(F.filter(cuts, lambda c: c < value)) + 1


def quantile_buckets(df: DataFrame, value: str, buckets: int, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    cuts = quantile_cuts(df, value, buckets, by).withColumnRenamed("cuts", "_cuts")
    # one row per group: broadcast, or the rows of a group would all go to one task
    joined = join_null_safe(df, F.broadcast(cuts), list(by)) if by else df.withColumn("_cuts", cuts.select("_cuts").scalar())
    name = F.concat(F.lit(prefix + "_q"), bucket_of(F.col(value), F.col("_cuts")).cast("string"))
    return joined.withColumn(f"{prefix}_bucket", name).drop("_cuts")


# -- W2 allocation -----------------------------------------------------------

def allocate(strata: DataFrame, key: str, size: str, target: int, floor: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Proportional quota per stratum within [floor, size] summing to the target.

    Strata whose floor exceeds their proportional share keep the floor; the
    others share the rest.  Ordering strata by floor/size makes the sharing
    ones a prefix, so the share is found with running sums, in whole numbers.
    The input is the small table of strata, not the rows.
    """
    group = Window.partitionBy(*by)
    base = strata.select(*by, key, F.col(size).cast("long").alias("_p"))
    base = base.withColumn("_all", F.sum("_p").over(group)).withColumn("_t", F.least(F.col("_all"), F.lit(target)))
    base = base.withColumn("_strata", F.count(F.lit(1)).over(group)).withColumn(
        "_t", F.when(F.col("_t") < F.col("_strata"), F.raise_error(F.lit("target is too small to keep every stratum"))).otherwise(F.col("_t"))
    )
    low = F.least(F.lit(floor).cast("long"), F.col("_p"))
    base = base.withColumn("_l", F.when(F.sum(low).over(group) > F.col("_t"), F.lit(1).cast("long")).otherwise(low))
    asc = Window.partitionBy(*by).orderBy(F.col("_l") / F.col("_p"), key)
    upto = asc.rowsBetween(Window.unboundedPreceding, 0)
    base = (
        base.withColumn("_j", F.row_number().over(asc))
        .withColumn("_den", F.sum("_p").over(upto))
        .withColumn("_num", F.col("_t") - (F.sum("_l").over(group) - F.sum("_l").over(upto)))
    )
    base = base.withColumn("_cut", F.max(F.when(F.col("_num") * F.col("_p") > F.col("_l") * F.col("_den"), F.struct("_j", "_num", "_den"))).over(group))
    shares = F.col("_j") <= F.coalesce(F.col("_cut._j"), F.lit(0))
    scaled = F.col("_cut._num") * F.col("_p")
    whole = F.when(shares, F.least(F.col("_p"), F.expr("(_cut._num * _p) div _cut._den"))).otherwise(F.col("_l"))
    fraction = F.when(shares, scaled - whole * F.col("_cut._den")).otherwise(F.lit(0))
    base = base.withColumn("_w", whole).withColumn("_f", fraction)
    by_fraction = Window.partitionBy(*by).orderBy((F.col("_w") >= F.col("_p")).cast("int"), F.col("_f").desc(), key)
    extra = F.row_number().over(by_fraction) <= F.col("_t") - F.sum("_w").over(group)
    return base.withColumn("_e", extra.cast("long")).select(
        *by, key, F.col("_p").alias("population"), F.col("_l").alias("floor"), (F.col("_w") + F.col("_e")).alias("allocation")
    )


# -- W3 parent-diverse stratified sample -------------------------------------

def tier_passes(df: DataFrame, split: str, stratum: str, parent: str, row_id: str, seed: int) -> DataFrame:
    """Adds the pass in which a row may be drawn: its hash rank inside (stratum, parent)."""
    hashed = df.withColumn("_th", hash_rank(seed, F.col(split), "tier", F.col(row_id))).withColumn(
        "_ph", hash_rank(seed, F.col(split), "parent", F.col(parent))
    )
    return rank_within(
        hashed, [split, stratum, parent], hash_bucket(F.col("_th"), 1), [F.col("_th"), F.col(row_id)], "pass"
    )


def stratified_sample(
    df: DataFrame, allocation: DataFrame, split: str, stratum: str, parent: str, row_id: str, seed: int, exact: bool = False
) -> DataFrame:
    """Allocated number of rows per stratum with as many distinct parents as possible.

    Rows are drawn in passes: nobody gives a second row before every parent of
    the stratum gave one.  Passes are counted first; whole passes are taken as
    they are, and only the pass that overshoots is ranked by parent hash.

    With `exact` the overshooting passes prefer parents that other strata used
    least so far.  That order is sequential over strata: one job per stratum,
    over the rows of its last pass only.
    """
    # strata and their passes are short lists, rows of a stratum are not: the lists are broadcast
    quota = F.broadcast(allocation.select(split, stratum, "allocation"))
    drawn = tier_passes(df, split, stratum, parent, row_id, seed).join(quota, [split, stratum])
    drawn = materialize(drawn.where(F.col("pass") <= F.col("allocation")), "passes")
    sizes = drawn.groupBy(split, stratum, "pass", "allocation").agg(F.count(F.lit(1)).alias("_n"))
    per_stratum = Window.partitionBy(split, stratum)
    earlier = per_stratum.orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(
        "_parents", F.max(F.when(F.col("pass") == 1, F.col("_n"))).over(per_stratum)
    )
    state = (
        F.when(F.col("_before") + F.col("_n") <= F.col("allocation"), "whole")
        .when(F.col("_before") < F.col("allocation"), "part")
    )
    sizes = sizes.withColumn("_state", state).where("_state is not null").select(split, stratum, "pass", "_before", "_parents", "_state")
    placed = join_null_safe(drawn, F.broadcast(sizes), [split, stratum, "pass"])
    whole, part = placed.where("_state = 'whole'"), placed.where("_state = 'part'")
    if exact:
        chosen = _least_used_first(whole, part, sizes, allocation, split, stratum, parent)
    else:
        order = [F.col("_ph"), F.col(parent)]
        ranked = rank_within(part, [split, stratum], hash_bucket(F.col("_ph"), 2), order, "_r")
        chosen = ranked.where(F.col("_r") <= F.col("allocation") - F.col("_before")).drop("_r")
    extra = ["_th", "_ph", "_before", "_parents", "_state", "allocation"]
    return whole.unionByName(chosen).drop(*extra)


def _least_used_first(
    whole: DataFrame, part: DataFrame, sizes: DataFrame, allocation: DataFrame, split: str, stratum: str, parent: str
) -> DataFrame:
    """Rows of the overshooting passes, stratum after stratum in (pass, parents, name) order."""
    turns = sizes.where("_state = 'part'").join(allocation.select(split, stratum, "allocation"), [split, stratum])
    steps = turns.orderBy(split, "pass", "_parents", stratum).collect()        # at most one per stratum
    picked = part.limit(0)
    for step in steps:
        here = (F.col(split) == step[split]) & (F.col(stratum) == step[stratum])
        turn = F.struct(F.col("pass"), F.col("_parents"), F.col(stratum))
        now = F.struct(F.lit(step["pass"]).alias("pass"), F.lit(step["_parents"]).alias("_parents"), F.lit(step[stratum]).alias(stratum))
        before = whole.where((F.col(split) == step[split]) & (turn < now)).select(parent)
        uses = before.unionByName(picked.where(F.col(split) == step[split]).select(parent)).groupBy(parent).agg(F.count(F.lit(1)).alias("_uses"))
        open_rows = part.where(here).join(uses, parent, "left").withColumn("_uses", F.coalesce("_uses", F.lit(0)))
        best = open_rows.orderBy("_uses", "_ph", parent).limit(step["allocation"] - step["_before"]).drop("_uses")
        picked = materialize(picked.unionByName(best.select(*picked.columns)), "picked")
    return picked


# -- W4 rare-character repair ------------------------------------------------

def _occurrences(label: str, char: str) -> Column:
    return (F.length(label) - F.length(F.replace(F.col(label), F.lit(char), F.lit("")))).cast("int")


def _character_totals(df: DataFrame, split: str, label: str, vocabulary: str) -> dict[str, dict[str, int]]:
    """Occurrences of every vocabulary character per split that has any; one row per split and character comes to the driver."""
    each = df.select(F.col(split).alias("s"), F.explode(F.split(label, "")).alias("c"))
    found = each.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("c").isin(*vocabulary)).collect()
    totals = {r["s"]: dict.fromkeys(vocabulary, 0) for r in found}
    for r in found:
        totals[r["s"]][r["c"]] = r["n"]
    return totals


def repair_coverage(
    rows: DataFrame, selected: DataFrame, vocabulary: str, minimum: int, split: str, parent: str, row_id: str, label: str, seed: int,
) -> DataFrame:
    """`selected` and the rows of `rows` that bring every character of every split to min(minimum, available) occurrences.

    Set-based, one step per missing character, rarest first: in each split the
    candidates that hold the character are ranked (parents without a selected
    row first, then more occurrences, then hash) and the first ones are taken
    until the deficit is covered.  A deficit is at most `minimum` and each
    candidate covers one of it, so the rank limit cuts the candidates before
    they meet.  Later steps start from what earlier ones added.  A rule that
    weighs every single addition anew can do with fewer rows; the guarantee
    per character is the same, and the number of jobs is bounded by the
    vocabulary, not by the additions.  What lacks only shrinks, so the rows
    that hold a character lacking at first are written once; `rows` and
    `selected` aren't read again by the steps, which add a few rows each.
    """
    available, chosen = (_character_totals(df, split, label, vocabulary) for df in (rows, selected))
    rarity = sorted(vocabulary, key=lambda c: (sum(t[c] for t in available.values()), c))

    def deficits(character: str, gained: dict[str, dict[str, int]]) -> dict[str, int]:
        found = {s: min(minimum, t[character]) - sum(h.get(s, {}).get(character, 0) for h in (chosen, gained)) for s, t in available.items()}
        return {s: n for s, n in found.items() if n > 0}

    wanted = F.lit(False)
    for character in rarity:
        for s in deficits(character, {}):
            wanted = wanted | (F.col(split).eqNullSafe(F.lit(s)) & (_occurrences(label, character) > 0))
    if not any(deficits(c, {}) for c in rarity):
        return selected

    def unused(candidates: DataFrame, picked: DataFrame) -> DataFrame:
        """Candidates that aren't picked, `_used` where their parent has a picked row."""
        used = picked.select(split, parent, F.lit(True).alias("_now")).distinct()
        marked = join_null_safe(candidates, used, [split, parent], "left").join(picked.select(row_id), row_id, "left_anti")
        return marked.withColumn("_used", F.col("_used") | F.coalesce("_now", F.lit(False))).drop("_now")

    candidates = materialize(unused(rows.where(wanted).withColumn("_used", F.lit(False)), selected), "repair-candidates")
    added, gained = None, {}
    for character in rarity:
        lacking = deficits(character, gained)
        if not lacking:
            continue
        deficit = F.lit(0)
        for s, n in lacking.items():
            deficit = F.when(F.col(split).eqNullSafe(F.lit(s)), n).otherwise(deficit)
        holders = candidates.withColumn("_n", _occurrences(label, character)).withColumn("_deficit", deficit).where("_n > 0 and _deficit > 0")
        holders = holders if added is None else unused(holders, added)
        order = ["_used", F.desc("_n"), hash_rank(seed, F.col(split), "repair", F.col(row_id)), F.col(row_id)]
        line = Window.partitionBy(split).orderBy(*order)
        first = holders.withColumn("_place", F.row_number().over(line)).where(F.col("_place") <= minimum)
        sofar = Window.partitionBy(split).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        taken = first.where("_place <= _deficit").withColumn("_sofar", F.coalesce(F.sum("_n").over(sofar), F.lit(0))).where("_sofar < _deficit")
        taken = taken.select(*selected.columns)
        added = materialize(taken if added is None else added.unionByName(taken), "repaired")
        gained = _character_totals(added, split, label, vocabulary)
    return selected.unionByName(added)


# -- W5-W7 splits and limits -------------------------------------------------

def group_split(df: DataFrame, key: str, seed: int, share: float = 0.15) -> DataFrame:
    """Test / calibration / development split of distinct keys by hash rank; sizes tie to even."""
    keys = df.select(key).distinct().withColumn("_h", tagged_hash(f"v2split:{seed}:", F.col(key)))
    ranked = rank_within(keys, [], hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], "split_rank")
    size = F.rint(keys.agg(F.count(F.lit(1)).alias("n")).scalar() * F.lit(share))
    name = (
        F.when(F.col("split_rank") <= size, SPLIT_NAMES[0])
        .when(F.col("split_rank") <= 2 * size, SPLIT_NAMES[1])
        .otherwise(SPLIT_NAMES[2])
    )
    return ranked.select(key, "split_rank", name.alias("assigned_split"))


def hash_sample(df: DataFrame, key: str, n: int, prefix: str = "42:") -> DataFrame:
    """All rows of the n keys with the smallest hashes."""
    chosen = df.select(key).distinct().orderBy(tagged_hash(prefix, F.col(key)), key).limit(n)
    return df.join(chosen, key, "left_semi")


def split_limit(df: DataFrame, split: str, names: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """First rows of each split, a total of n spread evenly; earlier splits get the remainder."""
    parts = [
        df.where(F.col(split) == name).orderBy(*order).limit(n // len(names) + int(k < n % len(names)))
        for k, name in enumerate(names)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- W8 width-budget batches -------------------------------------------------

def width_batches(
    df: DataFrame, row_id: str, width: str, budget: int, cap: int, seed: int = 42, epoch: int = 0, pool: int = 2048
) -> DataFrame:
    """Batches with max width * size within the budget and size within the cap.

    Rows are dealt into hash-ordered pools; each pool is packed on its own in
    width order, so a task never holds more than one pool.  A row wider than
    the budget is an error.
    """
    checked = df.select(row_id, F.col(width).cast("long").alias(width)).withColumn(
        width, F.when((F.col(width) > budget) | (F.col(width) < 1), F.raise_error(F.lit("width outside 1..budget"))).otherwise(F.col(width))
    )
    hashed = checked.withColumn("_h", hash_rank(seed + epoch, "pool", F.col(row_id)))
    ranked = rank_within(hashed, [], hash_bucket(F.col("_h")), [F.col("_h"), F.col(row_id)], "_r")
    pooled = ranked.withColumn("pool", F.floor((F.col("_r") - 1) / pool))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([width, "_h", row_id], kind="stable")
        numbers, size, batch = np.zeros(len(part), np.int64), 0, 0
        for k, w in enumerate(part[width].to_numpy()):
            if size and (size == cap or w * (size + 1) > budget):
                batch, size = batch + 1, 0
            numbers[k], size = batch, size + 1
        return part.assign(batch=numbers)[[row_id, width, "pool", "batch"]]

    kind = df.schema[row_id].dataType.simpleString()
    return pooled.groupBy("pool").applyInPandas(pack, f"{row_id} {kind}, {width} long, pool long, batch long")
