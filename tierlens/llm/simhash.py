"""SimHash near-copies: fingerprints, a grid range-join on segment bit counts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.llm import bitmaps
from tierlens.llm.common import free_name, quoted, removed, shuffled, written
from tierlens.llm.components import connected_components
from tierlens.llm.spans import BETWEEN_SPACES, Words, mixed, word_pieces

#: Differing bits up to which two fingerprints link.  The join below splits this budget over two halves; 3 = 1 + 2.
RADIUS = 3
#: Fingerprints per text that join dense groups before the exact search; they decide what it costs, not what it finds.
VIEWS = 1
#: Shingles that the exact search knows as common and asks for last.  Fewer make it slower, not less whole.
MAX_COMMON = 200_000
#: Bits of a text's parity, by which most pairs are ruled out before their shingle sets are made.
PARITY_BITS = 2_048
#: Shingles that a task counts together.
COUNT_SHINGLES = 4_000_000
SEED = 42
_ODD = 0x5555555555555555


def _shingle_hashes(piece: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the piece and the place of each row's first one (one more entry)."""
    followed = np.repeat(piece.first[1:], piece.counts) - 1 > np.arange(len(piece.start))
    edge = np.zeros(len(piece.data) + 1, np.int8)
    edge[piece.start] += 1
    edge[piece.end] -= 1
    keep = np.cumsum(edge, dtype=np.int8) > 0
    gaps = piece.end[followed]  # the white space after a word that has another behind it becomes one space
    keep[gaps] = True
    spaced = np.append(piece.data, np.uint8(0))
    spaced[gaps] = 32
    place = np.cumsum(keep) - 1
    joined = spaced[keep].tobytes()
    start, end = place[piece.start], place[piece.end - 1] + 1 if len(piece.end) else piece.end
    counts = piece.counts
    shingles = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(counts)), shingles)
    head = piece.first[row] + np.arange(first[-1]) - first[row]
    tail = np.minimum(head + width, piece.first[row + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(start[head].tolist(), end[tail].tolist())), np.uint64, len(head)
    )
    return hashes, first


def _shingle_names(piece: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of every shingle, made of its words' hashes, and the place of each row's first one (one more entry)."""
    words, counts = piece.hashes(), piece.counts
    shingles = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(counts)), shingles)
    head = piece.first[row] + np.arange(first[-1]) - first[row]
    last = piece.first[row + 1]
    names = np.zeros(len(head), np.uint64)
    for j in range(width):
        at = head + j
        there = at < last
        if there.all():
            names = mixed(names * np.uint64(3) + words[at])
        else:
            names[there] = mixed(names[there] * np.uint64(3) + words[at[there]])
    return names, first


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each row's hashes sorted and each kept once."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(first) - 1))]).astype(np.int64)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One unsigned fingerprint per row: the bits that are set in over half of its hashes."""
    shingles = np.diff(first)
    out = np.zeros(len(shingles), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int64)
        majority = ones * 2 > shingles[full][:, None]
        out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(
    docs: DataFrame, width: int = 3, text: str = "text", out: str = "fp", keep: list[str] | None = None, views: int = 0
) -> DataFrame:
    """Adds the SimHash of each whole text as a long (the bits of an unsigned value); `keep` names the columns to carry along.

    Words stand between ASCII white space, A-Z count as a-z, shingles are
    `width` words joined by one space, each hashed by XXH64 (seed 42) as often
    as it occurs.  With `views`, `out` is an array of so many fingerprints, each
    of the distinct shingles with their hashes mixed anew.  A text of fewer words is one shingle; a null text or one
    without words has fingerprint 0.
    """
    kept = keep if keep is not None else list(docs.columns)
    source = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias(inner := free_name(docs.select(*map(quoted, kept)), "_whole_text")))
    schema = source.drop(inner).withColumn(out, F.lit(None).cast("array<long>" if views else "long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(inner)
            found = [np.zeros((0, max(1, views)), np.uint64)]
            for _, _, piece in word_pieces(batch.column(at), BETWEEN_SPACES):
                hashes, first = _shingle_hashes(piece, width)
                if views:
                    hashes, first = _distinct(hashes, first)
                    found.append(np.stack([_majority(mixed(hashes + np.uint64(k + 1)), first) for k in range(views)], axis=1))
                else:
                    found.append(_majority(hashes, first)[:, None])
            flat = pa.array(np.concatenate(found).ravel().view(np.int64))
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * views), flat) if views else flat
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), made], names=schema.names)

    return source.mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary (00, 01, 11), packed in one long.

    The Manhattan distance of two such vectors is the number of bits in which
    the packed longs differ; it is never above the fingerprints' own distance.
    """
    up = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(F.lit(_ODD)), fp.bitwiseAND(up).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _within(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints at one or two differing bits, at most 65 per fingerprint.

    Each fingerprint names itself and its 64 one-bit neighbours; two that name
    a common value differ in two bits at most, and no value is named by more
    than 65.  Those that name it are chained in order, so a dense cloud of
    copies costs as much per row as a sparse one.
    """
    flips = F.array(*[F.lit(_signed(1 << k)) for k in range(64)], F.lit(0).cast("long"))
    named = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("named"))
    order = Window.partitionBy("named").orderBy("fp")
    return named.select("fp", F.lag("fp").over(order).alias("near")).where(F.col("near").isNotNull()).distinct()


def _halves(u: Column) -> Column:
    """The two half-vectors as (side, cell)."""
    low = u.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.array(
        F.struct(F.lit(0).cast("byte").alias("side"), F.shiftrightunsigned(u, 32).alias("cell")),
        F.struct(F.lit(1).cast("byte").alias("side"), low.alias("cell")),
    )


def grid_pairs(labelled: DataFrame) -> DataFrame:
    """Pairs (fp, other, group, other_group) of fingerprints in different groups at up to three differing bits, from (fp, group).

    A grid range-join: the bit-count vectors of two linked fingerprints lie
    within Manhattan distance 3, so in one half of the segments within 1.
    Cells are the lattice points of a half; a fingerprint stands in its two
    own cells and looks into every neighbouring cell at distance 0 or 1.
    Pairs must then be within 3 over all segments (lower bound) and in the
    fingerprints themselves (exact).  Members of a cell's largest group are
    never compared with each other.
    """
    stood = labelled.select("fp", "group", F.inline(_halves(embedding(F.col("fp")))))
    sizes = stood.groupBy("side", "cell", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("side", "cell").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups"))
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << k) for k in range(32)])
    high_bits = F.lit(0xAAAAAAAA)
    looking = (
        stood.select("fp", "group", "side", F.explode(F.transform(steps, lambda m: F.col("cell").bitwiseXOR(m))).alias("cell"))
        # only unary codes are cells: no segment has its upper bit alone
        .where(F.col("cell").bitwiseAND(high_bits).bitwiseAND(F.bitwise_not(F.shiftleft("cell", 1))) == 0)
        .join(shuffled(largest), ["side", "cell"])
        .where((F.col("group") != F.col("main")) | (F.col("groups") > 1))
        .select("fp", "group", "side", "cell", F.explode(
            F.when(F.col("group") != F.col("main"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        ).alias("in_main"))
    )
    standing = stood.join(shuffled(largest), ["side", "cell"]).select(
        "side", "cell", F.col("fp").alias("other"), F.col("group").alias("other_group"), (F.col("group") == F.col("main")).alias("in_main"),
    )
    met = looking.alias("l").join(
        shuffled(standing).alias("s"),
        (F.col("l.side") == F.col("s.side")) & (F.col("l.cell") == F.col("s.cell")) & (F.col("l.in_main") == F.col("s.in_main"))
        & (F.col("l.group") != F.col("s.other_group"))
        & _within(embedding(F.col("l.fp")), embedding(F.col("s.other"))) & _within(F.col("l.fp"), F.col("s.other")),
    )
    return met.select("l.fp", "s.other", "l.group", "s.other_group")


def grid_links(labelled: DataFrame) -> DataFrame:
    """Links (a, b) between groups that hold fingerprints at up to three differing bits."""
    return grid_pairs(labelled).select(F.least("group", "other_group").alias("a"), F.greatest("group", "other_group").alias("b")).distinct()


def near_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for a table of distinct fingerprints: all that chains of links of at most three differing bits join.

    First the links of up to two bits are contracted, then the grid join looks
    for links of three bits between what is left.
    """
    near = written(close_links(fps), "close-links")
    first = connected_components(near)
    labelled = written(
        fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")), "groups"
    )
    second = connected_components(grid_links(labelled))
    return labelled.join(second.withColumnRenamed("node", "group"), "group", "left").select("fp", F.coalesce("root", "group").alias("root"))


def near_copies(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id that links of three bits or fewer
    reach.  Rows without an id take part and get the id of their component,
    null where it has none; repeated rows stay repeated; an empty table gives
    an empty one.
    """
    marked = written(with_fingerprint(docs, width, keep=["doc_id"]), "fingerprints")
    ids = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    labelled = written(ids.join(near_components(ids.select("fp")), "fp").select("fp", "low", "root"), "components")
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = labelled.join(lowest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _only(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows (row number first) that the map of row numbers lets pass."""
    return batch.filter(pa.array(bitmaps.test(bits, bitmaps.row_places(batch.column(0).to_numpy()))))


def shingle_sets(placed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the rows of `placed` (row, text) that `wanted` (node, row) names: the distinct shingles, sorted.

    Sets are made where the text lies; a map of the wanted rows keeps the
    others' sets from being made, the join drops those it let pass wrongly.
    """
    shared = placed.sparkSession.sparkContext.broadcast(bitmaps.of_rows(wanted, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _only(batch, shared.value)
            for low, high, piece in word_pieces(batch.column(1), BETWEEN_SPACES):
                hashes, first = _distinct(*_shingle_names(piece, width))
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], names=["row", "shingles"])

    return placed.select("row", "text").mapInArrow(run, "row long, shingles array<long>").join(shuffled(wanted), "row").select("node", "shingles")


def parities(placed: DataFrame, distinct: DataFrame, width: int) -> DataFrame:
    """(row, size, parity) of the rows (row, text) that `distinct` (row) names: the size of the shingle set and, per bit, whether an odd number of shingles falls on it.

    Two sets differ in at least as many shingles as their parities in bits.
    """
    shared = placed.sparkSession.sparkContext.broadcast(bitmaps.of_rows(distinct, "row"))
    words = PARITY_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _only(batch, shared.value)
            for low, high, piece in word_pieces(batch.column(1), BETWEEN_SPACES):
                hashes, first = _distinct(*_shingle_names(piece, width))
                size = np.diff(first)
                bit = mixed(hashes) & np.uint64(PARITY_BITS - 1)
                place = np.repeat(np.arange(len(size)), size) * words + (bit >> np.uint64(6)).astype(np.int64)
                bits = np.zeros(len(size) * words, np.uint64)
                np.bitwise_xor.at(bits, place, np.left_shift(np.uint64(1), bit & np.uint64(63)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * words), pa.array(bits.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size.astype(np.int64)), lists], names=["row", "size", "parity"])

    return placed.select("row", "text").mapInArrow(run, "row long, size long, parity array<long>").join(distinct, "row", "left_semi")


def _may_be_similar(similarity: float) -> Column:
    """Whether sets with these sizes and parities can have the similarity: the differing bits bound what they share."""
    apart = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    both = F.col("m") + F.col("n")
    return (both - apart) / 2 >= F.lit(similarity / (1 + similarity)) * both - F.lit(1e-6)


def _similar(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, known: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have at least this Jaccard similarity; `sets` gives (node, shingles) of a table of nodes.

    With `known` (node, size, parity), pairs that can't reach it are dropped before sets are made.
    """
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if known is not None:
        sides = [known.select(F.col("node").alias(n), F.col("size").alias(m), F.col("parity").alias(p)) for n, m, p in (("a", "m", "p"), ("b", "n", "q"))]
        pairs = pairs.join(shuffled(sides[0]), "a").join(shuffled(sides[1]), "b").where(_may_be_similar(similarity)).select("a", "b")
    pairs = written(pairs, "candidate-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = written(sets(asked), "shingle-sets")
    both = pairs.join(shuffled(found.select(F.col("node").alias("a"), F.col("shingles").alias("x"))), "a").join(
        shuffled(found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - common
    links = written(both.where((total == 0) | (common >= F.lit(similarity) * total)).select("a", "b"), "similar-links")
    removed(pairs, found)
    return links


def common_shingles(texts: DataFrame, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places in the order from rare to common, from 1 on) of up to MAX_COMMON shingles that several texts of a task share, sorted by hash."""
    shared = texts.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[several].view(np.int64)), pa.array(counts[several].astype(np.int64))], names=["shingle", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, piece in word_pieces(_only(batch, shared.value).column(1), BETWEEN_SPACES):
                hashes, _ = _distinct(*_shingle_names(piece, width))
                held.append(hashes)
                size += len(hashes)
                if size >= COUNT_SHINGLES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    seen = texts.select("row", "text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = seen.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).toArrow()
    hashes = found["shingle"].to_numpy().view(np.uint64)
    place = np.arange(len(hashes), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], place[order]


def prefixes(texts: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """(shingle, short, size, at) from (row, short, text): the shingles of each text by which every similar text can be found, and their places in its order.

    All shingles stand in one order, common ones last.  Of two sets with at
    least this Jaccard similarity, the first n - ceil(similarity * n) + 1 of
    each (n its size) have one in common: if the prefixes were apart, too few
    could be shared.  That holds for any order; this one keeps groups small.
    A text without words has the shingle 0.

    `distinct` (column row) names one row of each text; the others' prefixes
    are the same and aren't made, but for a few that its map lets pass.  A
    shingle that only one text's prefix has can't meet another: a first pass
    marks the prefix shingles in a map, the second gives out those that came twice.
    """
    context = texts.sparkSession.sparkContext
    firsts = bitmaps.of_rows(distinct, "row")
    shared = context.broadcast((*common_shingles(texts, firsts, width), firsts))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of a piece, prefix shingles, their row in it, their place in its order, sizes of the rows' sets)."""
        names, rank, firsts = shared.value
        for batch in batches:
            batch = _only(batch, firsts)
            for low, high, piece in word_pieces(batch.column(2), BETWEEN_SPACES):
                hashes, first = _distinct(*_shingle_names(piece, width))
                size = np.diff(first)
                row = np.repeat(np.arange(len(size)), size)
                if len(names) and len(hashes):
                    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                    order = np.lexsort((hashes, np.where(names[at] == hashes, rank[at], 0), row))
                    hashes = hashes[order]
                kept = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
                place = np.arange(len(hashes)) - first[row]
                taken = place < kept[row]
                bare = np.flatnonzero(size == 0)
                none = np.zeros(len(bare), np.int64)
                yield (
                    batch.slice(low, high - low), np.concatenate([hashes[taken], none.astype(np.uint64)]), np.concatenate([row[taken], bare]),
                    np.concatenate([place[taken], none]), size,
                )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmaps.Seen()
        for _, hashes, *_ in made(batches):
            seen.add(hashes)
        yield seen.parts()

    rows = texts.select("row", "short", "text")
    several = context.broadcast(bitmaps.seen_twice(rows.mapInArrow(mark, bitmaps.PARTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, hashes, row, place, size in made(batches):
            met = bitmaps.test(several.value, hashes & np.uint64(bitmaps.BITS - 1))
            hashes, row, place = hashes[met], row[met], place[met]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), piece.column(1).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["shingle", "short", "size", "at"],
            )

    return rows.mapInArrow(run, "shingle long, short long, size int, at int")


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-6)


def _places_allow(size: str, left: Column, other: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar that share at most `left` shingles."""
    return left >= F.lit(similarity / (1 + similarity)) * (F.col(size) + other) - F.lit(1e-6)


def meetings(found: DataFrame) -> DataFrame:
    """(shingle, short, size, at, head, head_size, least) of the prefix shingles that several texts have.

    The head is the one with the fewest rarer shingles, so mostly the middle of a cloud of near copies; the least is the smallest size.
    """
    same = Window.partitionBy("shingle")
    return (
        found.withColumn("head", F.min(F.struct("at", "short", "size")).over(same)).withColumn("least", F.min("size").over(same))
        .withColumn("low", F.min("short").over(same)).withColumn("high", F.max("short").over(same)).where("low != high")
        .select("shingle", "short", "size", "at", F.col("head.short").alias("head"), F.col("head.size").alias("head_size"), "least")
        .dropDuplicates(["shingle", "short"])
    )


def pairs_between_groups(stood: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of texts of different groups that meet in a shingle and may be similar, from (shingle, short, size, at, group).

    Members of a shingle's largest group are never compared with each other.
    A pair is told by the first shingle that both have: what stands before it
    isn't shared, so each set's size less the shingle's place bounds what is.
    At later shingles the bound may rule a similar pair out, at the first it can't.
    """
    sizes = stood.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").drop("groups")
    apart = written(stood.join(largest, "shingle").select("shingle", "short", "size", "at", "group", (F.col("group") == F.col("main")).alias("in_main")), "apart")
    met = apart.where("NOT in_main").alias("l").join(
        shuffled(apart).alias("s"),
        (F.col("l.shingle") == F.col("s.shingle")) & (F.col("l.group") != F.col("s.group")) & (F.col("s.in_main") | (F.col("l.short") < F.col("s.short")))
        & _sizes_allow("l.size", "s.size", similarity)
        & _places_allow("l.size", F.least(F.col("l.size") - F.col("l.at"), F.col("s.size") - F.col("s.at")), F.col("s.size"), similarity),
    )
    return met.select(F.least("l.short", "s.short").alias("x"), F.greatest("l.short", "s.short").alias("y")).distinct()


def fingerprint_pairs(grouped: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different groups whose fingerprints differ in at most three bits, one pair for each two of (fingerprint, group).

    `grouped` has (fp, group, node).  The grid join runs on a narrow hash of the group; the few pairs that it finds carry it back to the nodes.
    """
    stood = written(grouped.groupBy("fp", F.xxhash64("group").alias("group")).agg(F.min("node").alias("node")), "fingerprint-groups")
    left, right = stood.withColumnRenamed("node", "a"), stood.select(F.col("fp").alias("other"), F.col("group").alias("other_group"), F.col("node").alias("b"))
    return grid_pairs(stood.select("fp", "group")).join(left, ["fp", "group"]).join(right, ["other", "other_group"]).select("a", "b")


def similar_components(
    nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], found: DataFrame, known: DataFrame, similarity: float = 0.8, views: int = VIEWS
) -> DataFrame:
    """(node, root) of near copies among distinct texts (node, short, fps); `sets` gives (node, shingles) for a table of nodes, `found` their prefixes, `known` (node, size, parity).

    A link counts only if the sets of shingles have a Jaccard
    similarity of `similarity` or more.  First each text is compared with the
    head of its fingerprint, with those that close_links finds and with
    the heads of its prefix shingles; that contracts dense groups.  Then the
    grid join gives the pairs of groups whose fingerprints differ in three bits
    or fewer, and all texts of different groups that meet in a prefix shingle
    and may be similar by its place are compared, so that no similar pair is
    left between two groups.  Where `found` has no places, none is ruled out by them.
    """
    if "at" not in found.columns:
        found = found.withColumn("at", F.lit(0))
    named = [nodes.select(F.col("short").alias(s), F.col("node").alias(n)) for s, n in (("x", "a"), ("y", "b"))]
    met = written(meetings(found), "prefix-meetings")
    stars = met.where(_sizes_allow("size", "head_size", similarity) & (F.col("short") != F.col("head"))).select(F.col("short").alias("x"), F.col("head").alias("y")).distinct()
    candidates = stars.join(named[0], "x").join(named[1], "y").select("a", "b")
    of_views = []
    for k in range(views):
        heads = written(nodes.select(F.col("fps")[k].alias("fp"), "node").groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
        of_views.append(heads)
        left, right = heads.select("fp", F.col("head").alias("a")), heads.select(F.col("fp").alias("near"), F.col("head").alias("b"))
        same = nodes.select(F.col("fps")[k].alias("fp"), F.col("node").alias("a")).join(heads, "fp").select("a", F.col("head").alias("b"))
        near = close_links(heads.select("fp")).join(left, "fp").join(right, "near").select("a", "b")
        candidates = candidates.unionByName(same).unionByName(near)
    links = _similar(candidates, sets, similarity, known)
    removed(*of_views)
    grouped = written(nodes.join(connected_components(links), "node", "left").select("node", "short", "fps", F.coalesce("root", "node").alias("group")), "groups")
    # most of a dense cloud's texts that aren't similar can't be so to the smallest text of the shingle either
    open_ = met.where(_places_allow("size", F.col("size") - F.col("at"), F.col("least"), similarity))
    stood = written(open_.select("shingle", "short", "size", "at").join(shuffled(grouped.select("short", "group")), "short"), "grouped-meetings")
    removed(met)
    between = pairs_between_groups(stood, similarity).join(named[0], "x").join(named[1], "y").select("a", "b")
    for k in range(views):
        between = between.unionByName(fingerprint_pairs(grouped.select(F.col("fps")[k].alias("fp"), "group", "node")))
    return connected_components(links.unionByName(_similar(between, sets, similarity, known)))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near copies: that with the smallest doc_id.

    Near copies are texts whose sets of `width`-word shingles have a Jaccard
    similarity of `similarity` or more, or that a chain of such texts joins.
    Candidates are the links of up to three bits between fingerprints of the
    distinct words (those of one or two bits join dense groups, the grid join
    finds the others), all of them checked on their sets; beside them every
    pair that fingerprints miss meets in a shingle of its prefixes.
    Equal texts, null counting as empty, are one group.  Rows
    without an id come after those with one; rows alike in doc_id are told
    apart by a hash of all columns, repeated rows by their place.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row_place")
    columns = [F.col(quoted(c)) for c in docs.columns]
    placed = written(with_fingerprint(docs, 1, out=fp, views=VIEWS).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    hashed = F.xxhash64(*[c.cast("string") for c in columns])
    text = F.coalesce("text", F.lit(""))
    short = F.xxhash64(text)  # a narrow name; texts that share one by chance are told apart by the node
    narrow = placed.select(
        F.md5(text.cast("binary")).alias("node"), short.alias("short"), F.col(fp).alias("fps"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), hashed.alias("row_hash"), F.col(row).alias("place")).alias("rank"),
    )
    firsts = written(narrow.groupBy("node").agg(F.min("rank").alias("rank"), F.first("short").alias("short"), F.first("fps").alias("fps")), "distinct-texts")

    lines = placed.select(F.col(row).alias("row"), short.alias("short"), text.alias("text"))

    def sets(asked: DataFrame) -> DataFrame:
        """Shingle sets of some nodes, from the rows that stand for them."""
        return shingle_sets(lines, firsts.join(asked, "node").select("node", F.col("rank.place").alias("row")), width)

    distinct = firsts.select(F.col("rank.place").alias("row"))
    known = parities(lines, distinct, width).join(shuffled(firsts.select("node", F.col("rank.place").alias("row"))), "row").select("node", "size", "parity")
    found = prefixes(lines, distinct, width, similarity)
    groups = similar_components(firsts.select("node", "short", "fps"), sets, found, written(known, "parities"), similarity)
    chosen = firsts.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rank").alias("rank"))
    return placed.join(chosen.select(F.col("rank.place").alias(row)), row, "left_semi").select(*columns)
