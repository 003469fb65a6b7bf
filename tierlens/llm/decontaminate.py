"""Benchmark decontamination by suffix arrays over the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tierlens.llm.common import free_name, quoted
from tierlens.llm.spans import ALPHANUMERIC, Words, text_buffers, word_pieces, words

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Benchmark text that one pass over the documents looks for, in bytes; a larger benchmark is looked for in several passes.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


class TestBlock:
    """The distinct windows of some benchmark items, in the order of their word hashes, and the items that hold each."""

    __test__ = False  # not a test class

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.window = window
        found = words(*text_buffers(pa.array(texts, pa.string())), ALPHANUMERIC)
        hashes, body = found.hashes(), found.data.tobytes()
        spelled = [body[a:b] for a, b in zip(found.start.tolist(), found.end.tolist())]
        holders: dict[tuple[bytes, ...], set[str]] = {}
        place: dict[tuple[bytes, ...], int] = {}
        for k, name in enumerate(ids):
            low, high = int(found.first[k]), int(found.first[k + 1])
            width = min(window, high - low)
            for at in range(low, high - width + 1) if width else ():
                key = tuple(spelled[at : at + width])
                holders.setdefault(key, set()).add(name)
                place.setdefault(key, at)
        self.words = list(holders)
        self.items = [sorted(holders[w]) for w in self.words]
        self.width = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.zeros((len(self.words), window), np.uint64)
        for row, key in enumerate(self.words):
            self.hashes[row, : len(key)] = hashes[place[key] : place[key] + len(key)]
        # every test suffix, for the length of the longest match: item words one after the other, 0 between items
        self.text = np.zeros(len(hashes) + len(ids) + 1, np.uint64)
        self.text[np.arange(len(hashes)) + found.rows() + 1] = hashes
        self.suffixes = _suffix_array(self.text, np.flatnonzero(self.text), max(1, int(found.counts.max(initial=1))))
        self.starts = np.zeros(1 << _FILTER_BITS, bool)
        self.starts[self.hashes[:, 0] >> np.uint64(64 - _FILTER_BITS)] = True
        self.pairs = np.zeros(1 << _FILTER_BITS, bool)
        wide = self.width > 1
        self.pairs[_pair(self.hashes[wide, 0], self.hashes[wide, 1])] = True
        self.single = not wide.all()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _FILTER_BITS)


def _suffix_array(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """`places` in the order of the `depth` words of `text` from each on (0 past the end), by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        ahead = np.zeros_like(rank)
        ahead[:-length] = rank[length:] if length < len(rank) else 0
        rank, length = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64), 2 * length
        if len(rank) == rank.max() + 1:
            break
    return places[np.argsort(rank[places], kind="stable")]


def _before(text: np.ndarray, places: np.ndarray, keys: np.ndarray, width: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each key (row of word hashes, its first `width` count) whether the suffix at its place is before it (or starts with it)."""
    undecided, out = np.arange(len(places)), np.zeros(len(places), bool)
    for k in range(keys.shape[1]):
        ended = width[undecided] <= k
        out[undecided[ended]] = or_equal
        undecided = undecided[~ended]
        if not len(undecided):
            return out
        have, want = text[places[undecided] + k], keys[undecided, k]
        out[undecided[have < want]] = True
        undecided = undecided[have == want]
    out[undecided] = or_equal
    return out


def _bounds(text: np.ndarray, order: np.ndarray, keys: np.ndarray, width: np.ndarray, or_equal: bool) -> np.ndarray:
    """Binary search of all keys at once: the number of suffixes in `order` before each key (with those that start with it)."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        up = _before(text, order[middle], keys[open_], width[open_], or_equal)
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
    return low


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Length of the longest common word run from places `at` of a and `bt` of b (0 ends a text)."""
    length, going = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(going):
        x, y = at[going] + length[going], bt[going] + length[going]
        fits = (x < len(a)) & (y < len(b))
        same = np.zeros(len(going), bool)
        same[fits] = (a[x[fits]] == b[y[fits]]) & (a[x[fits]] != 0)
        going = going[same]
        length[going] += 1
    return length


def _longest(text: np.ndarray, places: np.ndarray, test: TestBlock) -> np.ndarray:
    """Longest verbatim match of each suffix of `text` with any test suffix: one of its two neighbours in the test suffix array has it."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(test.suffixes), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        other = test.suffixes[middle]
        length = _common(text, places[open_], test.text, other)
        up = test.text[other + length] < text[places[open_] + length]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
    best = np.zeros(len(places), np.int64)
    for near in (low - 1, low):
        there = (near >= 0) & (near < len(test.suffixes))
        best[there] = np.maximum(best[there], _common(text, places[there], test.text, test.suffixes[near[there]]))
    return best


def _search(piece: Words, test: TestBlock) -> list[tuple[list[tuple[int, int]], list[str], int]]:
    """Per row of the piece: hit spans (first word, words), ids of the items found, words of the longest match."""
    rows = len(piece.first) - 1
    nothing: list = [([], [], 0)] * rows
    if not len(piece.start) or not len(test.words):
        return nothing
    row = piece.rows()
    hashes = piece.hashes()
    text = np.zeros(len(hashes) + rows + test.window + 1, np.uint64)  # a 0 after every document: no match crosses it
    place = np.arange(len(hashes)) + row
    text[place] = hashes
    # suffixes that can start a match; the array is built over these
    able = test.pairs[_pair(text[place], text[place + 1])]
    if test.single:
        able |= test.starts[hashes >> np.uint64(64 - _FILTER_BITS)]
    suffixes = np.flatnonzero(able)
    if not len(suffixes):
        return nothing
    keys = [text[place[suffixes] + k] for k in range(test.window)]
    order = place[suffixes][np.lexsort(keys[::-1])]
    low = _bounds(text, order, test.hashes, test.width, False)
    high = _bounds(text, order, test.hashes, test.width, True)
    word_at = np.zeros(len(text), np.int64)
    word_at[place] = np.arange(len(hashes))
    body = piece.data.tobytes()
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    hits: list[int] = []
    for k in np.flatnonzero(high > low).tolist():
        want, width = test.words[k], len(test.words[k])
        for f in word_at[order[low[k] : high[k]]].tolist():
            if all(body[a:b] == w for a, b, w in zip(piece.start[f : f + width].tolist(), piece.end[f : f + width].tolist(), want)):
                r = int(row[f])
                spans.setdefault(r, []).append((f - int(piece.first[r]), width))
                items.setdefault(r, set()).update(test.items[k])
                hits.append(f)
    longest: dict[int, int] = {}
    at = np.unique(np.array(hits, np.int64))
    for r, n in zip(row[at].tolist(), _longest(text, place[at], test).tolist()):
        longest[r] = max(longest.get(r, 0), n)
    return [(_union(spans[r]), sorted(items[r]), longest[r]) if r in spans else ([], [], 0) for r in range(rows)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, width in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            begin, length = out[-1]
            out[-1] = (begin, max(length, start + width - begin))
        else:
            out.append((start, width))
    return out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of bounded size; the driver holds one block at a time."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where(F.col("t").isNotNull())
    for row in rows.toLocalIterator():
        if ids and size + len(row["t"]) > BLOCK_BYTES:
            yield TestBlock(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"])
    if ids:
        yield TestBlock(ids, texts, window)


def _empty_block(window: int) -> TestBlock:
    return TestBlock([], [], window)


#: What the search adds to a document.
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,words:bigint>>,items:array<string>,longest:bigint>"


def with_matches(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, out: str = "found", window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """Adds to each document what it shares with the benchmark, as struct `out`.

    n_words, spans (merged word ranges inside occurrences of benchmark
    windows), items (sorted distinct ids of items with an occurring window,
    as text), longest (words of the longest verbatim match at such a place).

    Every task builds suffix arrays over pieces of its documents' words,
    binary-searches every test window in them and checks each occurrence word
    by word.  Nothing is shuffled.  The benchmark goes out in blocks of
    bounded size, one pass in the same stage for each.

    Words are runs of ASCII letters, digits and other characters, A-Z as a-z.
    A null or empty text has no words and no match; so has a null benchmark
    text; an item without id is listed as the empty string; repeated rows on
    either side change nothing; an empty benchmark finds nothing.  `keep`
    names the columns to carry along (all by default; `out` must not be one).
    """
    kept = list(docs.columns) if keep is None else keep
    inner = free_name(docs.select(*map(quoted, kept)), "_whole_text")
    frame = docs.select(*[F.col(quoted(c)) for c in kept], F.col("text").alias(inner))
    blocks = list(map(spark.sparkContext.broadcast, _blocks(benchmark, window))) or [spark.sparkContext.broadcast(_empty_block(window))]
    for number, block in enumerate(blocks):
        frame = _pass(frame, inner, out, block, number == len(blocks) - 1)
    return frame


def _pass(frame: DataFrame, inner: str, out: str, block, last: bool) -> DataFrame:
    base = [c for c in frame.columns if c != out and not (last and c == inner)]
    schema = frame.select(*map(quoted, base)).withColumn(out, F.lit(None).cast(FOUND)).schema
    kind = pa.struct([
        ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
        ("items", pa.list_(pa.string())), ("longest", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = block.value
        for batch in batches:
            names = batch.schema.names
            earlier = batch.column(names.index(out)).to_pylist() if out in names else None
            rows = []
            for low, _, piece in word_pieces(batch.column(names.index(inner)), ALPHANUMERIC):
                counts = piece.counts.tolist()
                for k, (spans, items, longest) in enumerate(_search(piece, test)):
                    if earlier:
                        was = earlier[low + k]
                        spans = _union([*spans, *((s["start"], s["words"]) for s in was["spans"])])
                        items, longest = sorted({*items, *was["items"]}), max(longest, was["longest"])
                    rows.append({"n_words": counts[k], "spans": [{"start": a, "words": b} for a, b in spans], "items": items, "longest": longest})
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in base), pa.array(rows, kind)], names=schema.names)

    return frame.mapInArrow(run, schema)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = with_matches(spark, docs, benchmark, window=window, keep=["doc_id"])
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"),
        F.col("found.longest").alias("longest"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents in which a benchmark window occurs."""
    out = free_name(docs, "found")
    found = with_matches(spark, docs, benchmark, out=out, window=window)
    return found.where(F.size(F.col(out)["spans"]) == 0).drop(out)


