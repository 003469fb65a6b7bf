import hashlib
import random
import zlib

import pytest

from tierlens.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}
    rebuilt = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = talks.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in below)
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 1_000_003, 1_000_004, 7_000_000_001]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice((1, 2, 3, 5, 9, 14))):
            rows.append((c, rng.choice((turn, turn, turn, None)), rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "é ß", "", None)) if rng.random() < 0.7 else f"t{rng.randrange(99)}"))
    same = [(turn, "user" if turn % 2 == 0 else "assistant", f"said {turn}") for turn in range(4)]
    rows += [(c, *t) for c in range(200, 260) for t in same]       # conversations that are all alike
    rows += [(None, 0, "user", "no id"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    rng.shuffle(rows)
    return rows


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("counters", [1 << 24, 1 << 4])
def test_same_as_brute_force_however_full_the_sketch_is(spark, monkeypatch, counters):
    rows = talk_rows(1)
    monkeypatch.setattr(prefix_trie, "MOST_COUNTERS", counters)
    turns = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "'mine' as node", "0 as depth")
    assert got(prefix_trie.trie_nodes(turns)) == brute(rows)


def test_hot_parents_joined_or_broadcast_are_the_same(spark, monkeypatch):
    rows = talk_rows(2)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 0.5)
    assert got(prefix_trie.trie_nodes(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_empty_table_and_one_conversation(spark):
    assert got(prefix_trie.trie_nodes(spark.createDataFrame([], TURNS))) == []
    rows = [(4, 0, "user", "hello " * 50_000)]
    assert got(prefix_trie.trie_nodes(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_a_conversation_without_turns_left_is_a_member_of_the_root(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 0, "user", "gone")]
    assert got(prefix_trie.trie_nodes(spark.createDataFrame(rows, TURNS))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_many_ends_are_hashed_in_numeric_order(spark):
    ends = spark.range(30_000).selectExpr("cast('0123456789abcdef' as binary) as node", "id - 15000 as conv_id").repartition(7)
    digest = prefix_trie.ends_digests(spark, ends).collect()
    want = hashlib.sha256(",".join(str(k) for k in range(-15_000, 15_000)).encode()).hexdigest()
    assert [r["ends_sha256"] for r in digest] == [want]


def test_the_sketch_never_underestimates(spark):
    rows = spark.range(5_000).selectExpr("unhex(md5(cast(id % 3000 as string))) as node").repartition(4)
    bits = prefix_trie.sketch(rows, 1 << 12)
    import numpy as np
    twice = [hashlib.md5(str(k).encode()).digest() for k in range(2_000)]
    place = prefix_trie._places(np.frombuffer(b"".join(twice), np.uint64).reshape(-1, 2), 1 << 12)
    assert ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all()
