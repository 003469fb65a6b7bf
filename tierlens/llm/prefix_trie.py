"""The trie of conversation prefixes: a count-min sketch proves most prefixes single, only the others are shuffled and grouped exactly."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tierlens.llm.common import hot_lookup, task_count, written

#: Rows of the sketch.
HASHES = 3
#: Counters of one sketch row, at most; a fuller sketch shuffles more prefixes and changes no result.
MOST_COUNTERS = 1 << 24
#: Counters that tasks hand on together.
BLOCK = 1 << 16
#: A prefix with this share of all prefix rows or more is broadcast to its children: at most 1 / HOT_SHARE prefixes.
HOT_SHARE = 1e-5

# fixed values: the rebuilding rule
_GROUP = 5
_HEADS = 9

_ROOT = bytes(16)
_PREFIXES = "conv_id long, depth long, node binary, parent binary, bytes long, last boolean"


def _chained(parent: bytes, role: str, text: str) -> tuple[bytes, int]:
    """(digest of a prefix with one more turn, bytes of the turn's text)."""
    said, words = role.encode(), text.encode()
    return hashlib.blake2b(parent + struct.pack("<Q", len(said)) + said + words, digest_size=16).digest(), len(words)


def _rebuilt_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix rows of every rebuilt conversation; turns come sorted, a group's base conversation first.

    What is held is the base's first turns and one conversation's first
    turns until the borrowed ones are known, both at most _HEADS - 1.
    """
    out: list[tuple] = []
    base = current = None
    head: list[tuple[str, str]] = []       # the first turns of the group's base
    node, depth, borrowed, seen, waiting = _ROOT, 0, 0, 0, None

    def add(role: str, text: str) -> None:
        """The next rebuilt turn; the row before it is complete now, and not the last."""
        nonlocal node, depth, waiting
        child, size = _chained(node, role, text)
        out.append((*waiting, False))
        depth += 1
        waiting = (current, depth, child, node, size)
        node = child

    def close() -> None:
        if waiting is not None:
            out.append((*waiting, True))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "depth", "node", "parent", "bytes", "last"])

    for some in batches:
        for group, conv, take, role, text in zip(*(some.column(i).to_pylist() for i in range(5))):
            if conv != current:
                close()
                if group != base:
                    base, head = group, []
                current, seen, borrowed = conv, 0, take
                node, depth, waiting = _ROOT, 0, (conv, 0, _ROOT, None, 0)
                if conv != base:
                    for said in head[:borrowed]:
                        add(*said)
            seen += 1
            if conv == base and len(head) < _HEADS - 1:
                head.append((role, text))
            # the base's own first turns are the borrowed ones
            if conv == base or seen > borrowed:
                add(role, text)
            if len(out) >= 8192:
                yield batch()
    close()
    if out:
        yield batch()


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes, last): every prefix of every rebuilt conversation, by digest.

    One exchange: the conversations that share a base lie in one task, in
    order, and pass as a stream.
    """
    conv = F.col("conv_id").cast("long")
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % _GROUP).alias("base"), conv.alias("conv_id"), (F.crc32(conv.cast("string").cast("binary")) % _HEADS).cast("int").alias("take"),
        text(F.col("role")).alias("role"), text(F.col("text")).alias("text"), "turn",
    )
    sorted_rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    return sorted_rows.select("base", "conv_id", "take", "role", "text").mapInArrow(_rebuilt_prefixes, _PREFIXES)


def _halves(column: pa.Array) -> np.ndarray:
    """Both 64-bit halves of each 16-byte digest; zero for null."""
    if column.null_count:
        column = column.fill_null(_ROOT)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _places(halves: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each digest in each sketch row, numbered through all rows."""
    mask = np.uint64(counters - 1)
    with np.errstate(over="ignore"):
        return np.stack([((halves[:, 0] + np.uint64(r) * halves[:, 1]) & mask).astype(np.int64) + r * counters for r in range(HASHES)], 1)


def sketch(rows: DataFrame, counters: int) -> np.ndarray:
    """Which counters of the count-min sketch of `rows` (column node) are 2 or more.

    Counters stop at 2, which is all that screening asks.  A task hands on
    two bit maps a block (1 or more, 2 or more); blocks merge as a stream.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(HASHES * counters, np.uint8)
        for batch in batches:
            if batch.num_rows:
                place, n = np.unique(_places(_halves(batch.column(0)), counters), return_counts=True)
                seen[place] = np.minimum(seen[place] + np.minimum(n, 2), 2)
        blocks = seen.reshape(-1, min(BLOCK, counters))
        some = np.flatnonzero(blocks.any(1))
        bits = lambda least: pa.array([np.packbits(blocks[b] >= least).tobytes() for b in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some), bits(1), bits(2)], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = once = twice = None
        for batch in batches:
            for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if b != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([twice.tobytes()], pa.binary())], names=["block", "twice"])
                    block, once, twice = b, o, t
                else:
                    once, twice = once | o, twice | t | (once & o)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([twice.tobytes()], pa.binary())], names=["block", "twice"])

    parts = rows.select("node").mapInArrow(count, "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, twice binary").toArrow()
    size = min(BLOCK, counters)
    out = np.zeros(HASHES * counters // size * size // 8, np.uint8)
    for block, twice in zip(merged["block"].to_pylist(), merged["twice"].to_pylist()):
        out[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(twice, np.uint8)
    return out


def screened(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """`rows` with `shared` and `above`: whether the prefix, and the one before it, may have more than one member."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    counters = len(bits) * 8 // HASHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            tested = []
            for name in ("node", "parent"):
                place = _places(_halves(batch.column(name)), counters)
                tested.append(((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(1))
            # the root is one prefix, even of a single conversation: it takes the exact way
            depth = batch.column("depth").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tested[0] | (depth == 0)), pa.array(tested[1] | (depth == 1))], names=[*batch.schema.names, "shared", "above"])

    return rows.mapInArrow(run, _PREFIXES + ", shared boolean, above boolean")


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) per run of equal nodes: sorted rows (node, conv_id), the ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        halves = _halves(batch.column(0))
        edge = np.flatnonzero(np.append(True, (halves[1:] != halves[:-1]).any(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(halves)).astype(np.int32)), batch.column(1).cast(pa.string()))
        at = pa.array(edge)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pc.binary_join(lists, ",")], names=["node", "first", "ids"])


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from the joined runs, sorted: one running digest, however many runs a node has."""
    node = digest = None
    nodes, digests = [], []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(digest.hexdigest())
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        nodes, digests = [], []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends_digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): ids in numeric order, comma-joined.

    Ids are joined in ranges of (node, id), so that a node with very many
    ends is many tasks' work; only the joined pieces meet for the digest.
    """
    ranged = ends.select("node", "conv_id").repartitionByRange(task_count(spark), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_joined_ends, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed_ends, "node binary, ends_sha256 string")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations in `turns` (conv_id, turn, role, text).

    Conversation c is rebuilt: the first h turns of conversation c - c % 5
    (the remainder has c's sign), then its own turns after its first h, with
    h = crc32(c as text) % 9.  Turns stand in the order of turn, null first,
    then role and text; a null role or text is empty; repeated rows are turns
    of their own; a row without conv_id belongs to no conversation.  An
    empty table has no node.  Only the four columns are read, so others
    never clash.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  Prefixes are told apart by 128-bit digests.

    A prefix that the sketch proves single is written where it lies: one
    member, one leaf below it, nothing saved.  Sums over a subtree are taken
    along the smallest member of each node, whose prefixes are the node's
    ancestors: each conversation sums upwards what it stands for, each node
    adds its members up.
    """
    spark = turns.sparkSession
    rows = written(prefixes(turns), "prefixes")
    total = rows.count()
    counters = 1 << min(MOST_COUNTERS.bit_length() - 1, max(16, (4 * total).bit_length()))
    marked = written(screened(rows, sketch(rows, counters)), "screened")
    many, alone = marked.where("shared"), marked.where(~F.col("shared"))
    nodes = many.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("parent").alias("parent"), F.max("above").alias("above"),
    )
    nodes = written(nodes, "nodes")
    children = nodes.where("above").select("parent").unionByName(alone.where("above").select("parent")).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes-children")
    stands = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    carried = many.select("conv_id", "depth", "node").join(stands, ["conv_id", "depth"], "left").unionByName(
        alone.where("last").select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    )
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = carried.select("node", F.sum(F.coalesce("saved", F.lit(0))).over(upwards).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0))).over(upwards).alias("leaf"))
    sums = sums.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_digests(spark, many.where("last"))
    none = hashlib.sha256(b"").hexdigest()
    exact = nodes.join(sums, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent", "above"]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    local = alone.select(
        "conv_id", "depth", one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"), "parent", "above",
    )
    # the prefix before a single one that may be shared has its smallest member in the table; any other one's is the conversation itself
    result = written(exact.select(columns).unionByName(local.select(columns)), "trie")
    known = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("_members"))
    below = (F.col("depth") > 0) & F.col("above")
    parented = hot_lookup(result.where(below), "parent", known, F.col("_members") >= F.lit(max(2.0, total * HOT_SHARE))).drop("_members")
    rest = result.where(~below).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return parented.unionByName(rest).select("conv_id", "depth", "parent_conv_id", *columns[2:7])
