"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.llm.common import free_name, id_text, quoted, task_count, without, written

SHARDS = 24
#: Probes that each round puts between two neighbouring keys of an open splitter.
PROBES = 16
#: How far a splitter may be from its exact place, as a share of a shard.  0: the nearest place between two keys.
TOLERANCE = 0.0
_DIGITS = 32


def shard_key(text: Column, doc_id: Column) -> Column:
    """Sort key of 32 hex digits: 16 of the text's hash, then 16 of the id's, so equal texts are neighbours and a large group of them can still be cut."""
    head = F.substr(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(1), F.lit(16))
    tail = F.substr(F.md5(F.coalesce(id_text(doc_id), F.lit("")).cast("binary")), F.lit(1), F.lit(16))
    return F.concat(head, tail)


def _bin(key: Column, bounds: list[str]) -> Column:
    """Number of bounds at or below the key, by binary search in one literal array."""
    if not bounds:
        return F.lit(0)
    listed, n = F.split(F.lit(",".join(bounds)), ","), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at)
    )


def _hex(x: int) -> str:
    return f"{x:0{_DIGITS}x}"


def _between(low: str, high: str, probes: int) -> list[str]:
    """Up to `probes` keys k with low < k <= high, evenly spaced."""
    a, b = int(low, 16), int(high, 16)
    return sorted({_hex(a + max(1, (b - a) * k // probes)) for k in range(1, probes + 1)}) if b > a else []


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[str]:
    """`parts` - 1 keys that cut (key, size) rows into parts of near equal size; a part holds the keys from its splitter on.

    Histogram sort.  Each round counts, in one map-side aggregation, the exact
    sizes between all candidate keys (with the smallest and largest key in
    each gap), and each splitter that isn't within `tolerance` of its place
    gets new probes inside the one gap that holds it.  A gap with a single key
    can't be cut; the splitter then is the nearer of its two ends.  What comes
    to the driver is one row for each candidate, not for each key.
    """
    total, smallest, largest = keys.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if not total:
        return []
    wanted = [total * k / parts for k in range(1, parts)]
    end = _hex(int(largest, 16) + 1)
    found: dict[int, str] = {}
    # for each open splitter: the gap [low key, high key) that holds it and the size below the low key
    gaps = {k: (smallest, end, 0, total) for k in range(len(wanted))}
    tries = {k: _between(smallest, largest, probes) for k in gaps}
    while gaps:
        bounds = sorted({b for k in gaps for b in (gaps[k][0], *tries[k], gaps[k][1])})
        inside = keys.where((F.col("key") >= bounds[0]) & (F.col("key") < bounds[-1]))
        place = {b: n for n, b in enumerate(bounds)}
        histogram = {
            r["bin"]: r for r in inside.groupBy(_bin(F.col("key"), bounds).alias("bin"))
            .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        }
        still = {}
        for k, (low, high, below, _) in gaps.items():
            first, last = place[low], place[high]
            for b in range(first, last):
                row = histogram.get(b + 1)
                if row is None:
                    continue
                if below + row["size"] >= wanted[k] or b == last - 1:
                    after = below + row["size"]
                    # the gap [bounds[b], bounds[b + 1]) holds the place; its keys run from row.low to row.high
                    near, far = wanted[k] - below, after - wanted[k]
                    slack = tolerance * total / parts
                    if row["low"] == row["high"] or min(near, far) <= slack:
                        found[k] = row["low"] if near <= far else _hex(int(row["high"], 16) + 1)
                    else:
                        still[k] = (row["low"], _hex(int(row["high"], 16) + 1), below, after)
                        tries[k] = _between(row["low"], row["high"], probes)
                    break
                below += row["size"]
        gaps = still
    return [found[k] for k in sorted(found)]


def with_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, keep: list[str] | None = None) -> DataFrame:
    """Adds size, shard (0 to shards - 1) and slot (0, 1, ... within each shard) to each row of `docs` (columns doc_id, text).

    The law is bytes: sizes of shards are near equal, each boundary standing
    at the document end nearest to its exact place.  Size is the UTF-8 bytes
    of the text (0 for null) plus 8.  Rows are ordered by hash of text, then of
    id: equal texts are neighbours, and a group of copies is cut only where a
    boundary falls into it.  Rows alike in both can't be told apart by the key
    and share a shard; their slots follow a hash of all columns.  Columns of
    the documents that are named size, shard or slot are replaced; `keep`
    names those to carry along.  An empty table gives an empty one.

    Only narrow keys are read in the rounds; the rows are exchanged once, into
    pieces of shards that are found in the same rounds, and numbered there.
    """
    source = without(docs, "size", "shard", "slot")
    kept = [c for c in source.columns if keep is None or c in keep]
    key, piece, tie = free_name(docs, "shard_key"), free_name(docs, "shard_piece"), free_name(docs, "shard_tie")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    made = shard_key(F.col("text"), F.col("doc_id"))
    keys = written(source.select(made.alias("key"), size.alias("size")), "shard-keys")
    fine = -(-task_count(docs.sparkSession) // shards)  # pieces of a shard: tasks that number rows side by side
    cuts = splitters(keys, shards * fine, tolerance)
    if not cuts:
        cuts = [_hex(1)] * (shards * fine - 1)
    counts = {r["piece"]: r["rows"] for r in keys.groupBy(_bin(F.col("key"), cuts).alias("piece")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    ahead, seen = [], 0
    for p in range(shards * fine):
        seen = 0 if p % fine == 0 else seen
        ahead.append(seen)
        seen += counts.get(p, 0)
    order = Window.partitionBy(piece).orderBy(key, tie)
    return (
        source.select(
            *[F.col(quoted(c)) for c in kept], size.alias("size"), made.alias(key), F.xxhash64(*[F.col(quoted(c)).cast("string") for c in source.columns]).alias(tie)
        )
        .withColumn(piece, _bin(F.col(key), cuts))
        .withColumn("slot", (F.row_number().over(order) - 1).cast("long") + F.element_at(F.array(*[F.lit(n).cast("long") for n in ahead]), F.col(piece) + 1))
        .withColumn("shard", F.floor(F.col(piece) / fine).cast("int"))
        .select(*[F.col(quoted(c)) for c in kept], "size", "shard", "slot")
    )
