import collections
import re

from awkward_tables import DOCS, awkward, awkward_rows, empty, with_clashes

from tierlens.llm import mixing, sharding


def shares(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by rounds of resharing; sizes in the order of sources."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    capped, total = {}, sum(sizes.values())
    while True:
        left, open_ = total - sum(capped.values()), [s for s in sizes if s not in capped]
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if level[s] >= repeats * sizes[s]]
        if not above:
            return {**capped, **level}
        capped.update({s: float(repeats * sizes[s]) for s in above})
        if len(capped) == len(sizes):
            return capped


def in_order(sources):
    return sorted(sources, key=lambda s: (s is None, (s or "").encode()))


def check_mix(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = shares({s: sizes[s] for s in in_order(sizes)})
    taken = collections.Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    largest = max((r["size"] for r in got), default=0)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest + 0.02 * sum(sizes.values())
    return got


def test_mix_of_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] != 5]
    first = check_mix(spark, rows)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(k, "a b c d", None, "s0", None) for k in range(200)] + [(1000 + k, "a b", None, "s1", None) for k in range(5)] + [(2000, "a", None, None, None)]
    got = check_mix(spark, rows)
    assert {r["times"] for r in got if r["source"] == "s1"} == {3}


def test_mix_without_words_or_rows(spark):
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], DOCS)).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0), (0, 0)]
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_repeats_rows(spark):
    docs = with_clashes(awkward(spark), "row_place", "mix_times", "size", "row", "target")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    times = {(r["doc_id"], r["source"], r["size"]): r["times"] for r in mixing.mix(docs).collect()}
    counted = collections.Counter((r["doc_id"], r["source"]) for r in got.collect())
    assert all(counted[(d, s)] >= (t if size else 1) for (d, s, size), t in times.items())
    assert counted[(2, "a")] == 1


def by_shard(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def check_shards(rows, total_rows, shards):
    assert len(rows) == total_rows
    groups = by_shard(rows)
    for members in groups.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        assert abs(sum(r["size"] for r in groups.get(k, [])) - total / shards) <= largest + 1


def test_shards_are_near_equal(spark):
    rows = [(k, "x" * (k * 37 % 400), None, None, None) for k in range(700)] + [(5000 + k, "the same text " * 9, None, None, None) for k in range(400)]
    got = sharding.with_shards(spark.createDataFrame(rows, DOCS), 7).collect()
    check_shards(got, len(rows), 7)
    copies = {r["shard"] for r in got if r["doc_id"] >= 5000}
    assert copies == set(range(min(copies), max(copies) + 1))  # a large group is cut by boundaries only
    again = sharding.with_shards(spark.createDataFrame(rows, DOCS).repartition(3), 7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_splitters_within_a_tolerance(spark):
    keys = spark.range(5000).selectExpr("md5(cast(id as string)) AS key", "id % 50 + 1 AS size")
    cuts = sharding.splitters(keys, 6, tolerance=0.05)
    listed = sorted((r["key"], r["size"]) for r in keys.collect())
    total = sum(s for _, s in listed)
    for k, cut in enumerate(cuts, 1):
        assert abs(sum(s for key, s in listed if key < cut) - total * k / 6) <= 0.05 * total / 6
    assert cuts == sorted(cuts) and len(cuts) == 5


def test_awkward_rows_and_repeats(spark):
    docs = with_clashes(awkward(spark), "size", "Slot", "shard_key", "shard_tie", "shard_piece")
    got = sharding.with_shards(docs, 5)
    assert [c for c in got.columns if c not in ("size", "shard", "slot")] == [c for c in docs.columns if c.lower() not in ("size", "slot")]
    rows = got.collect()
    assert len(rows) == len(awkward_rows())
    for members in by_shard(rows).values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    same = spark.createDataFrame([(1, "a", None, None, None)] * 50, DOCS)
    assert sorted(r["slot"] for r in sharding.with_shards(same, 4).collect()) == list(range(50))
    assert sharding.with_shards(empty(spark)).count() == 0
