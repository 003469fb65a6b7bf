"""Phrase collocations per language: tries of candidate phrases walked at all text positions at once, exact counts of all phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tierlens.llm.common import free_name, hot_lookup, written
from tierlens.llm.double_array import DoubleArray
from tierlens.llm.spans import Words, mixed, word_pieces

#: A phrase seen less often is no candidate.
LEAST = 30
#: Words in the longest phrase.
LONGEST = 4
#: Results per language.
TOP = 2_000
#: Phrases in the broadcast trie, at most; those beyond are counted through the shuffle.
TRIE_PHRASES = 1 << 17
#: Words of the sample from which the trie's phrases are chosen, about.
SEED_WORDS = 4_000_000
#: Bits of the broadcast filter that tells which shorter phrases may be frequent.
FILTER_BITS = 1 << 26
#: Words that a task counts together before it hands partial counts on.
COUNT_WORDS = 4_000_000
#: A table row with this share of all words or more is broadcast instead of joined by key: at most 1 / HOT_SHARE rows a table.
HOT_SHARE = 1e-5

_BYTES = np.arange(256)
# fixed values: the signs that end a piece, and the blanks between words
_BREAKS = np.isin(_BYTES, list(b".,;:!?\x0a\x0b\x0c\x0d"))
_INSIDE = ~(_BREAKS | np.isin(_BYTES, [0x20, 0x09]))
_NO_LANGUAGE = "und"


def _language_names(column: pa.Array) -> np.ndarray:
    """A 64-bit name per row's language."""
    coded = column.dictionary_encode()
    names = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return np.array(names, np.uint64)[coded.indices.to_numpy()]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words, np.ndarray, np.ndarray]]:
    """(languages, words, names, joined) of the columns (lang, text), piece by piece.

    `names` tells words of one language apart from all others; `joined` says
    that a word follows another one in the same piece of the text.
    """
    for batch in batches:
        languages = batch.column(0)
        if not len(languages):
            continue
        marks = _language_names(languages)
        for low, high, found in word_pieces(batch.column(1), _INSIDE):
            n = len(found.start)
            if not n:
                continue
            names = mixed(found.hashes() ^ np.repeat(marks[low:high], found.counts))
            joined = np.ones(n + 1, bool)
            joined[found.first[:-1]] = False
            joined[np.searchsorted(found.start, np.flatnonzero(_BREAKS[found.data]))] = False
            yield languages.slice(low, high - low), found, names, joined[:n]


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a phrase with one more word; _longer_key is the same for columns."""
    return ((key << np.uint64(17)) | (key >> np.uint64(47))) ^ word


def _longer_key(key: Column, word: Column) -> Column:
    return F.shiftleft(key, 17).bitwiseOR(F.shiftrightunsigned(key, 47)).bitwiseXOR(word)


def _key(words: list[Column]) -> Column:
    key = words[0]
    for word in words[1:]:
        key = _longer_key(key, word)
    return key


def _texts_of(found: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as an Arrow column."""
    size = found.end[at] - found.start[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = found.data[np.repeat(found.start[at] - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))


def _word_table(texts: DataFrame) -> DataFrame:
    """(lang, word, w1, n): how often each word of each language occurs, w1 its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for languages, found, names, _ in _words(batches):
            name, at, n = np.unique(names, return_index=True, return_counts=True)
            rows = np.searchsorted(found.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [languages.take(pa.array(rows)), _texts_of(found, at), pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "w1", "n"]
            )

    return texts.mapInArrow(run, "lang string, word string, w1 long, n long").groupBy("lang", "word", "w1").agg(F.sum("n").alias("n"))


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of a column of names: a name without its bit isn't there."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    filled = keys.select(F.shiftright(bit, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    filled = filled.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(FILTER_BITS - 1)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _starts(joined: np.ndarray, k: int) -> np.ndarray:
    """Whether k words of one piece start at each of the first n - k + 1 places."""
    n = len(joined)
    whole = np.ones(max(n - k + 1, 0), bool)
    for i in range(1, k):
        whole &= joined[i : i + len(whole)]
    return whole


def _seed(texts: DataFrame, bits: np.ndarray, words: int) -> DoubleArray:
    """The trie: the most frequent phrases of a sample of texts, all of whose words are frequent.

    Which phrases it holds decides what counting costs, not what is counted.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    columns = [f"w{i}" for i in range(1, LONGEST + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, names, joined in _words(batches):
            often = _maybe(shared.value, names)
            for k in range(2, LONGEST + 1):
                whole = _starts(joined, k)
                for i in range(k):
                    whole &= often[i : i + len(whole)]
                at = np.flatnonzero(whole)
                key = names[at]
                for i in range(1, k):
                    key = _longer(key, names[at + i])
                _, one, n = np.unique(key, return_index=True, return_counts=True)
                said = [pa.array(names[at[one] + min(i, k - 1)].view(np.int64)) for i in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), k)), *said, pa.array(n.astype(np.int64))], names=["k", *columns, "n"])

    every = max(1, words // SEED_WORDS)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = some.mapInArrow(run, "k long, " + ", ".join(f"{c} long" for c in columns) + ", n long").groupBy("k", *columns).agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "k", *columns).limit(TRIE_PHRASES).toArrow()
    phrases = np.stack([best[c].to_numpy() for c in columns], 1).view(np.uint64) if best.num_rows else np.zeros((0, LONGEST), np.uint64)
    return DoubleArray(phrases, best["k"].to_numpy())


def _phrase_table(texts: DataFrame, trie: DoubleArray, shorter: np.ndarray, k: int) -> DataFrame:
    """(pre, last, n) of every phrase of k words whose first and last k - 1 words may be frequent; pre names the first k - 1 words.

    One pass: the trie's states of all places advance word by word, those
    that accept are counted in one array per task; what the trie doesn't hold
    is counted by name, and all partial counts are summed by Spark.
    """
    shared = texts.sparkSession.sparkContext.broadcast((trie, shorter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, shorter = shared.value
        seen = np.zeros(len(trie), np.int64)
        first, last = np.zeros(len(trie), np.uint64), np.zeros(len(trie), np.uint64)
        states, others, held = [], [], 0

        def rows(pre: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pre.view(np.int64)), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["pre", "last", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            if states:
                seen += np.bincount(np.concatenate(states), minlength=len(seen))
            if others:
                pre, word = (np.concatenate(x) for x in zip(*others))
                _, at, n = np.unique(_longer(pre, word), return_index=True, return_counts=True)
                yield rows(pre[at], word[at], n)
            states.clear()
            others.clear()

        for _, _, names, joined in _words(batches):
            whole = _starts(joined, k)
            if not len(whole):
                continue
            codes = trie.codes(names)
            state = trie.step(np.zeros(len(whole), np.int64), codes[: len(whole)])
            state[~whole] = -1
            for i in range(1, k):
                state = trie.step(state, codes[i : i + len(whole)])
            pre = names[: len(whole) + 1]
            for i in range(1, k - 1):
                pre = _longer(pre, names[i : i + len(whole) + 1])
            taken = np.flatnonzero(state >= 0)
            states.append(state[taken])
            first[state[taken]], last[state[taken]] = pre[taken], names[taken + k - 1]
            able = _maybe(shorter, pre)
            rest = np.flatnonzero(whole & (state < 0) & able[:-1] & able[1:])
            others.append((pre[rest], names[rest + k - 1]))
            held += len(names)
            if held >= COUNT_WORDS:
                yield from flush()
                held = 0
        yield from flush()
        some = np.flatnonzero(seen)
        yield rows(first[some], last[some], seen[some])

    return texts.mapInArrow(run, "pre long, last long, n long").groupBy("pre", "last").agg(F.sum("n").alias("n"))


def _parts(k: int) -> list[tuple[int, int]]:
    """(place, length) of every contiguous part of k words, itself left out."""
    return [(i, j) for j in range(1, k) for i in range(k - j + 1)]


def _exploded(phrases: DataFrame, k: int, least: int = 1) -> DataFrame:
    """One row per phrase of k words and part of at least `least` words: (key, a, i, j, part)."""
    parts = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _key([F.col(f"w{x + 1}") for x in range(i, i + j)]).alias("part")) for i, j in _parts(k) if j >= least]
    return phrases.select("key", "n", F.lit(k).alias("k"), F.explode(F.array(*parts)).alias("p")).select("key", F.col("n").alias("a"), "k", "p.i", "p.j", "p.part")


def candidates(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(candidates, words): every phrase of 2 to 4 words seen `least` times or more in a language, and the count of all words per language.

    Candidates have (key, lang, phrase, k, a, l, r, score, kept): the lowest
    score over all cuts, the first such cut's l and r, and whether no longer
    candidate stands for the phrase.
    """
    texts = docs.select(F.coalesce("lang", F.lit(_NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(_word_table(texts), "words")
    words = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") >= F.lit(max(least, total * HOT_SHARE))
    tables = [counts.where(F.col("n") >= least).select(F.col("w1").alias("key"), "w1", "n", "lang", "word")]
    bits = _filter(tables[0].select("key"))
    trie = _seed(texts, bits, total)
    for k in range(2, LONGEST + 1):
        found = _phrase_table(texts, trie, bits, k).where(F.col("n") >= least)
        known = [f"w{i}" for i in range(1, k)]
        found = written(found, f"phrases-{k}")
        found = hot_lookup(found, "pre", tables[-1].select(F.col("key").alias("pre"), *known, F.col("n").alias("_n")), hot_n(total, least, "_n")).drop("_n")
        found = written(found.select(_longer_key(F.col("pre"), F.col("last")).alias("key"), *known, F.col("last").alias(f"w{k}"), "n"), f"phrases-{k}-words")
        tables.append(found)
        bits = _filter(found.select("key"))
    none = F.lit(None).cast("string")
    known = tables[0].select(F.col("key").alias("part"), "n", "lang", "word")
    for table in tables[1:-1]:
        known = known.unionByName(table.select(F.col("key").alias("part"), "n", none.alias("lang"), none.alias("word")))
    exploded = [_exploded(table, k) for k, table in enumerate(tables[1:], 2)]
    longer = [_exploded(table, k, 2) for k, table in enumerate(tables[1:], 2) if k > 2]
    rows, above = exploded[0], longer[0]
    for more in exploded[1:]:
        rows = rows.unionByName(more)
    for more in longer[1:]:
        above = above.unionByName(more)
    rows = hot_lookup(rows, "part", known, hot)
    part = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))
    whole = rows.groupBy("key", "k", "a").agg(
        F.max("lang").alias("lang"), *[part(i, 1, "word").alias(f"word{i}") for i in range(LONGEST)], *[part(i, j, "n").alias(f"n{i}{j}") for i, j in _parts(LONGEST)]
    )
    cuts = []
    for k in range(2, LONGEST + 1):
        for j in range(1, k):
            left, right = F.col(f"n0{j}"), F.col(f"n{j}{k - j}")
            score = F.expr(f"cast(cast(a as decimal(20, 0)) * 2000000 div (cast(n0{j} as decimal(20, 0)) + n{j}{k - j}) as bigint)")
            cuts.append(F.when(F.col("k") == k, F.struct(score.alias("score"), F.lit(j).alias("j"), left.alias("l"), right.alias("r"))))
    whole = whole.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))).select(
        "key", "lang", F.concat_ws(" ", *[f"word{i}" for i in range(LONGEST)]).alias("phrase"), "k", "a", "cut.l", "cut.r", "cut.score"
    )
    above = above.groupBy(F.col("part").alias("key")).agg(F.max("a").alias("above"))
    covered = F.expr("cast(above as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * 80")
    whole = whole.join(above, "key", "left")
    return whole.withColumn("kept", ~F.coalesce(covered, F.lit(False))).drop("above"), words


def hot_n(total: int, least: int, column: str) -> Column:
    """Whether a count is so large that few rows of a table can have it."""
    return F.col(column) >= F.lit(max(least, total * HOT_SHARE))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of 2 to 4 words.

    Words are what stands between blanks, A-Z as a-z, inside pieces that end
    at `.,;:!?` or a line end.  A phrase's score is 2,000,000 a / (l + r),
    whole, for its counts a and those of its two parts at the cut where that
    is lowest; a phrase that a longer one stands for in 80 of 100 places is left
    out.  A null language is `und`, a null or empty text has no words;
    repeated rows count as often as they stand; an empty table gives no rows.
    Only the columns lang and text are read, so others never clash.

    Counting is exact: a shorter phrase that is rare rules its longer ones
    out, and the filter that tells so errs on the safe side only.  Words and
    phrases are told apart by 64-bit hashes.
    """
    found, words = candidates(docs, least)
    found = found.where("kept")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    split = free_name(found, "split")
    first = Window.partitionBy("lang", split).orderBy(*order)
    some = found.withColumn(split, F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return some.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
