import hashlib
import random
import re

import pytest
import xxhash
from awkward_tables import DOCS, awkward, awkward_rows, empty, with_clashes
from pyspark.sql import functions as F

from tierlens.llm import simhash
from tierlens.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(fps):
    """Root (smallest signed value) of each fingerprint by comparing all pairs."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(parent)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in listed}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_near_components_lose_no_link(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(250):  # a dense cloud around one value, at up to 8 bits
        x = centre
        for bit in rng.sample(range(64), rng.randrange(9)):
            x ^= 1 << bit
        fps.add(x)
    for x in list(fps)[:60]:  # chains in steps of three bits
        for _ in range(3):
            for bit in rng.sample(range(64), 3):
                x ^= 1 << bit
            fps.add(x)
    fps = {signed(x) for x in fps}
    got = simhash.near_components(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert {r["fp"]: r["root"] for r in got} == components(fps) and len(got) == len(fps)


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_awkward_rows(spark):
    got = simhash.near_copies(awkward(spark)).collect()
    want = [(r[0], fingerprint(r[1])) for r in awkward_rows()]
    assert sorted(((r["doc_id"], r["fp"] % 2**64) for r in got), key=str) == sorted(want, key=str)
    roots = components({signed(f) for _, f in want})
    smallest = {}
    for i, f in want:
        if i is not None:
            smallest[roots[signed(f)]] = min(i, smallest.get(roots[signed(f)], i))
    assert all(r["component_id"] == smallest.get(roots[r["fp"]]) for r in got)
    text = awkward(spark).where("doc_id = 1").select(F.col("text"))
    assert simhash.with_fingerprint(text).select(simhash.hex_fingerprint(F.col("fp"))).first()[0] == f"{fingerprint(awkward_rows()[0][1]):016x}"


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = with_clashes(awkward(spark), "fp", "row_place", "root", "rank")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert 1 in ids and 6 not in ids and 2 in ids and not {3, 4} & set(ids) and len(ids) == len(set(ids))


@pytest.mark.parametrize("run", [simhash.near_copies, simhash.keep_one])
def test_empty(spark, run):
    assert run(empty(spark)).count() == 0


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def similar_groups(rows):
    """Smallest id of each group that chains of Jaccard 0.8 join, by comparing all pairs."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union == 0 or len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for k, r in enumerate(rows):
        out.setdefault(find(k), []).append(r[0])
    return list(out.values())


def test_keep_one_catches_near_copies_and_leaves_others(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(150)), None, None, None) for k in range(60)]
    for k in range(120):  # one or two changed words: similarity 0.87 or more
        words = rows[k % 20][1].split(" ")
        for _ in range(1 + k % 2):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((1000 + k, " ".join(words), None, None, None))
    for k in range(15):  # half the words changed: another document
        words = [w if j % 2 else f"other{k}x{j}" for j, w in enumerate(rows[k][1].split(" "))]
        rows.append((2000 + k, " ".join(words), None, None, None))
    rows += [(3000, rows[3][1].upper(), None, None, None), (3001, "  " + rows[3][1].replace(" ", "\n"), None, None, None)]
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    groups = similar_groups(rows)
    assert all(any(i in kept for i in g) for g in groups)  # nothing is lost
    assert len(kept) == len(groups) and set(range(60)) <= set(kept) and not {3000, 3001} & set(kept)


def test_similarity_is_exact(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(900)}" for _ in range(104)]
    rows = [(1, " ".join(base), None, None, None)]
    for k, places in enumerate(((50,), (20, 80), (20, 50, 80))):
        words = list(base)
        for at in places:
            words[at] = "changed"
        rows.append((2 + k, " ".join(words), None, None, None))
    pairs = spark.createDataFrame([("1", str(r[0])) for r in rows[1:]], "a string, b string")
    lines = spark.createDataFrame([(r[0], r[1]) for r in rows], "row long, text string")
    got = {r["b"] for r in simhash._similar(pairs, lambda asked: simhash.shingle_sets(lines, asked.select("node", F.col("node").cast("long").alias("row")), 5), 0.8).collect()}
    sets = [shingles(r[1]) for r in rows]
    assert got == {str(r[0]) for r, s in zip(rows[1:], sets[1:]) if len(s & sets[0]) >= 0.8 * len(s | sets[0])} == {"2", "3"}


def test_keep_one_misses_no_pair_near_the_bound(spark):
    rng = random.Random(21)
    rows = []
    for k in range(80):
        words = [f"b{rng.randrange(2000)}" for _ in range(104)]
        rows.append((k, " ".join(words), None, None, None))
        for copy, places in enumerate(((20, 80), (10, 50), (33, 34, 90))):  # similarity 0.8 to 0.83
            edited = list(words)
            for at in places:
                edited[at] = f"new{k}x{copy}x{at}"
            rows.append((1000 + 10 * k + copy, " ".join(edited), None, None, None))
    rows += [(5000 + k, "one two three four " + "x" * (k % 3), None, None, None) for k in range(9)]
    rows += [(6000 + k, " " * k, None, None, None) for k in range(4)]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted(min(g) for g in similar_groups(rows))


def test_common_lines_change_the_order_not_the_result(spark):
    rng = random.Random(22)
    line = " ".join(f"line{k}" for k in range(30))
    rows = [(k, " ".join(f"c{rng.randrange(500)}" for _ in range(3 + k % 60)) + " " + line, None, None, None) for k in range(150)]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted(min(g) for g in similar_groups(rows)) and 1 < len(kept) < 150


def test_a_shuffled_head_hides_no_pair_behind_it(spark):
    rng = random.Random(23)
    base = [f"s{k}" for k in range(120)]
    swapped = list(base)
    swapped[60], swapped[61] = swapped[61], swapped[60]
    texts = [" ".join(base), " ".join(swapped)]
    head = " ".join(rng.sample(base, 120))
    while hashlib.md5(head.encode()).hexdigest() > min(hashlib.md5(t.encode()).hexdigest() for t in texts):
        head = " ".join(rng.sample(base, 120))
    # one more word, so that fingerprints of the words differ a little or not at all
    near_head = " ".join([*base, "more"])
    rows = [(k, t, None, None, None) for k, t in enumerate([head, *texts, near_head])]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == sorted(min(g) for g in similar_groups(rows)) == [0, 1]


def test_copies_and_shingles_of_one_text_give_no_prefix_rows(spark):
    rng = random.Random(24)
    base = [f"p{rng.randrange(5000)}" for _ in range(110)]
    near = [*base[:109], "changed"]
    alone = [" ".join(f"q{k}x{j}" for j in range(60)) for k in range(40)]
    said = [" ".join(base)] * 5_000 + [" ".join(near)] + alone
    lines = spark.createDataFrame(list(enumerate(said)), "row long, text string").repartition(6).selectExpr("row", "xxhash64(text) as short", "text")
    distinct = lines.groupBy("text").agg(F.min("row").alias("row")).select("row")
    found = simhash.prefixes(lines, distinct, 5, 0.8).collect()
    assert {r["short"] for r in found} == {r["short"] for r in lines.where("row in (0, 5000)").collect()}
    assert 2 <= len(found) <= 2 * (106 - 85 + 1) and len(found) == len({(r["short"], r["shingle"]) for r in found})


def test_parities_rule_no_similar_pair_out(spark):
    rng = random.Random(25)
    said = []
    for _ in range(60):
        words = [f"r{rng.randrange(300)}" for _ in range(rng.randint(0, 200))]
        said.append(" ".join(words))
        for places in (1, 2, 5):
            said.append(" ".join("new" if words and rng.random() < places / len(words) else w for w in words))
    lines = spark.createDataFrame(list(enumerate(said)), "row long, text string").repartition(3)
    known = simhash.parities(lines, lines.select("row"), 5)
    left, right = known.selectExpr("row as a", "size as m", "parity as p"), known.selectExpr("row as b", "size as n", "parity as q")
    kept = {(r["a"], r["b"]) for r in left.join(right, F.col("a") < F.col("b")).where(simhash._may_be_similar(0.8)).select("a", "b").collect()}
    sets = [shingles(t) for t in said]
    similar = {(a, b) for a in range(len(said)) for b in range(a + 1, len(said)) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert similar <= kept and len(kept) < 1.2 * len(similar) + 50


def test_keep_one_links_fingerprints_three_bits_apart_by_the_grid_join(spark):
    text = " ".join(f"g{k}" for k in range(40))
    other = " ".join(f"h{k}" for k in range(40))
    lines = spark.createDataFrame([(0, text), (1, text), (2, other), (3, text)], "row long, text string")
    fps = [0, 0b111 << 20, 0b111 << 40, -1]  # 1 is three bits from 0; 2 as well, with another text; 3 is far away
    nodes = spark.createDataFrame([(str(k), k, [fp]) for k, fp in enumerate(fps)], "node string, short long, fps array<long>")
    sets = lambda asked: simhash.shingle_sets(lines, asked.select("node", F.col("node").cast("long").alias("row")), 5)
    known = simhash.parities(lines, lines.select("row"), 5).selectExpr("string(row) as node", "size", "parity")
    none = spark.createDataFrame([], "shingle long, short long, size int")
    groups = simhash.similar_components(nodes, sets, none, known).collect()
    assert {r["node"]: r["root"] for r in groups} == {"0": "0", "1": "0"}


def test_a_dense_cloud_below_the_bound_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(26)
    base = [f"d{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 8)):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words), None, None, None))
    made = []
    real = simhash.pairs_between_groups

    def counted(stood, similarity):
        pairs = real(stood, similarity)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "pairs_between_groups", counted)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    groups = similar_groups(rows)
    assert kept == sorted(min(g) for g in groups) and 100 < len(kept) < 390
    assert made[0] < 10 * len(rows)


def test_rows_of_the_grid_are_not_broadcast(spark):
    """Spark takes the 66 rows that a fingerprint becomes for one; a plan that broadcasts them fills the driver."""
    labelled = spark.range(3_000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("group"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # the default, above Spark's size of both sides
    plan = simhash.grid_pairs(labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan


def test_sets_and_meetings_are_not_broadcast(spark, monkeypatch):
    """Written tables count by their compressed files, rows of Arrow functions by their input."""
    plans = []
    monkeypatch.setattr(simhash, "written", lambda df, name, write=simhash.written: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    texts = [(k, " ".join(f"w{k // 2}x{j}" for j in range(40)) + f" end{k % 2}", None, None, None) for k in range(40)]
    assert simhash.keep_one(spark.createDataFrame(texts, DOCS)).count() == 20
    joins = [(name, plan) for name, plan in plans if name in ("parities", "similar-links", "grouped-meetings", "shingle-sets")]
    assert len(joins) == 6
    assert all("SortMergeJoin" in plan for _, plan in joins) and not any("BroadcastHashJoin" in plan for name, plan in joins if name in ("similar-links", "grouped-meetings"))
