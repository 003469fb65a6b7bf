"""Language-model scores by a weighted backoff automaton over smoothed word pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tierlens.llm.common import fold, removed, shuffles_freed, written
from tierlens.llm.spans import BETWEEN_SPACES, Words, word_pieces

#: Share of the training tokens from which on a word is a state and a pair an arc; 0: every word, and every pair seen PAIR_LEAST times.
SHARE = 0.0
#: Share from which on words and pairs are broadcast.  At most 1 / CACHE_SHARE of each can have it, whatever the corpus.  All others
#: stand in tables that are joined: the cache decides what scoring costs, not what it finds.
CACHE_SHARE = 1e-6
#: Bits of the broadcast filter that keeps most pairs without an arc out of that join.
FILTER_BITS = 1 << 26
#: A pair seen once is no arc.
PAIR_LEAST = 2
#: Parts, by the first bits of their names, in which rare pairs are joined one after the other; they decide the disk it takes, not what it finds.
PAIR_PARTS = 4
DISCOUNT = 0.75
#: Tokens that a task counts together before it hands partial counts on.
COUNT_TOKENS = 4_000_000

# fixed values beside the word hashes
_END = 2
_BEGIN = 3


def _tokens(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, an end after each row's words, and the place of each row's first token (one more entry)."""
    rows = len(found.first) - 1
    out = np.full(len(found.start) + rows, _END, np.uint64)
    out[np.arange(len(found.start)) + found.rows()] = found.hashes()
    return out, found.first + np.arange(rows + 1)


def _in(names: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted `names`, -1 where it isn't there."""
    if not len(names):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    return np.where(names[at] == hashes, at, -1)


def _counted(values: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct values, counts) of a stream of long arrays, in pieces of bounded size."""
    held: list[np.ndarray] = []
    size = 0
    for some in values:
        held.append(some)
        size += len(some)
        if size >= COUNT_TOKENS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _count_table(texts: DataFrame, values, name: str) -> DataFrame:
    """(name, n) over all texts: counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = (values(*_tokens(found)) for batch in batches for _, _, found in word_pieces(batch.column(0), BETWEEN_SPACES))
        for keys, counts in _counted(streams):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=[name, "n"])

    return texts.select("text").mapInArrow(run, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def _merged(values: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lists per row: its distinct values under the mask, and how often each is there."""
    row, some = np.repeat(np.arange(len(first) - 1), np.diff(first))[mask], values[mask]
    order = np.lexsort((some, row))
    row, some = row[order], some[order]
    fresh = np.ones(len(some), bool)
    fresh[1:] = (some[1:] != some[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(first) - 1))]).astype(np.int32))
    times = np.diff(np.append(at, len(some))).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(some[at].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token, the begin at the start of a row."""
    out = np.empty(len(tokens), np.uint64)
    out[1:] = tokens[:-1]
    out[first[:-1]] = _BEGIN
    return out


def _pair_keys(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit name per pair of token hashes; _pair_key is the same as a column."""
    return ((state << np.uint64(1)) | (state >> np.uint64(63))) ^ word


def _part(keys: np.ndarray) -> np.ndarray:
    """Part of each pair name."""
    return (keys >> np.uint64(48)) % np.uint64(PAIR_PARTS)


def _pair_key() -> Column:
    return F.shiftleft("state", 1).bitwiseOR(F.shiftrightunsigned("state", 63)).bitwiseXOR(F.col("word"))


def _pair_table(texts: DataFrame) -> DataFrame:
    """(state, word, n) over all texts: counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list) -> pa.RecordBatch:
            state, word = (np.concatenate(x) for x in zip(*held))
            _, at, n = np.unique(_pair_keys(state, word), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(state[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["state", "word", "n"])

        held, size = [], 0
        for batch in batches:
            for _, _, found in word_pieces(batch.column(0), BETWEEN_SPACES):
                tokens, first = _tokens(found)
                held.append((_before(tokens, first), tokens))
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return texts.select("text").mapInArrow(run, "state long, word long, n long").groupBy("state", "word").agg(F.sum("n").alias("n"))


@dataclass
class Automaton:
    """States and arcs as sorted arrays.

    States are the begin of a text and the words; here are the frequent ones
    and their frequent arcs, the others are joined.  From state u, the
    arc of word w has log10 of its smoothed probability; without such an arc
    the failure arc of u, with its own weight, leads to the root, whose arcs
    are the words alone.  The word read is the next state, or the root if it
    is none.
    """

    words: np.ndarray
    counts: np.ndarray
    fail: np.ndarray
    begin_fail: float
    arcs: np.ndarray
    weights: np.ndarray
    total: int
    vocabulary: int
    maybe: np.ndarray | None = None  # filter of the pairs whose arcs are in the table; None: there are none

    def single(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of words with these counts; the sum over all words and one unknown is 1."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))

    def walk(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One pass over the tokens of all rows from left to right.

        Per row: known tokens, base score and score over the arcs that are
        here; a mask of the tokens whose root arc is in the table instead; and
        one of the tokens whose own arc may be.
        """
        # the state before each token is the token before it, or the begin: no state needs more than that
        here = _in(self.words, tokens)
        state = np.empty(len(tokens), np.int64)
        state[1:] = here[:-1]
        begins = first[:-1]
        state[begins] = len(self.words)
        known = here >= 0
        single = np.zeros(len(tokens))
        single[known] = self.single(self.counts[here[known]])
        weight = single.copy()
        fail = np.append(self.fail, self.begin_fail)
        tried = np.flatnonzero(state >= 0)
        arc = np.full(len(tried), -1, np.int64)
        able = known[tried]
        arc[able] = _in(self.arcs, _arc(state[tried[able]], here[tried[able]]))
        taken = arc >= 0
        weight[tried[taken]] = self.weights[arc[taken]]
        weight[tried[~taken]] += fail[state[tried[~taken]]]
        late = np.zeros(len(tokens), bool)
        if self.maybe is not None:
            bit = _pair_keys(_before(tokens, first), tokens) & np.uint64(FILTER_BITS - 1)
            late = (self.maybe[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            late[tried[taken]] = False
        return (
            np.add.reduceat(known, begins, dtype=np.int64), np.add.reduceat(single, begins), np.add.reduceat(weight, begins), ~known, late
        )


def _arc(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (state.astype(np.int64) << 32) | word.astype(np.int64)


def fit(texts: DataFrame) -> tuple[DataFrame, Automaton]:
    """(word counts, automaton) of whole_fit."""
    words, _, model = whole_fit(texts)
    return words, model


def whole_fit(texts: DataFrame) -> tuple[DataFrame, DataFrame | None, Automaton]:
    """(words, late arcs, automaton) from the whole texts of `texts` (column text).

    `words` (word hash, n, fail) is a table of every word with its failure
    weight; the automaton holds the frequent words and pairs, a bounded number
    of each.  `late arcs` (key, bonus) has every other arc: what its weight is
    above that of the way over the root; None if there are none.  Words are
    told apart by a 64-bit hash, pairs by another.
    """
    spark = texts.sparkSession
    counts = written(_count_table(texts, lambda tokens, first: tokens.view(np.int64), "word"), "word-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = texts.count()
    arcs = written(_pair_table(texts).where(F.col("n") >= max(float(PAIR_LEAST), total * SHARE)), "arcs")
    shuffles_freed(spark)  # every pair of every task stood there
    kept = arcs.groupBy("state").agg(F.sum(F.col("n") - F.lit(DISCOUNT)).alias("kept"))
    from_begin = kept.where(F.col("state") == _BEGIN).first()
    begin_fail = float(np.log10(1 - (from_begin["kept"] if from_begin else 0.0) / max(rows, 1)))
    words = written(
        counts.join(kept.withColumnRenamed("state", "word"), "word", "left").select("word", "n", F.log10(1 - F.coalesce("kept", F.lit(0.0)) / F.col("n")).alias("fail")), "words"
    )
    share = max(SHARE, CACHE_SHARE)
    got = words.where(F.col("n") >= F.lit(total * share)).toArrow()
    names = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, own, fail = names[order], got["n"].to_numpy()[order], got["fail"].to_numpy()[order]
    model = Automaton(names, own, fail, begin_fail, np.zeros(0, np.int64), np.zeros(0), int(total), int(vocabulary))
    cached = F.col("n") >= F.lit(total * share)
    some = arcs.where(cached).toArrow()
    state, word, seen = (some[c].to_numpy() for c in ("state", "word", "n"))
    key = _arc(np.where(state == _BEGIN, len(names), _in(names, state.view(np.uint64))), _in(names, word.view(np.uint64)))
    order = np.argsort(key)
    model.arcs, seen = key[order], seen[order]
    left = model.arcs >> 32
    history = np.append(own, rows).astype(np.float64)
    alone = 10 ** model.single(own[model.arcs & 0xFFFFFFFF])
    model.weights = np.log10((seen - DISCOUNT) / history[left] + 10 ** np.append(fail, begin_fail)[left] * alone)
    if arcs.where(~cached).isEmpty():
        removed(arcs, counts)
        return words, None, model
    low = arcs.where(~cached)
    ahead = words.select(F.col("word").alias("state"), F.col("n").alias("history"), "fail").unionByName(
        spark.range(1).select(F.lit(_BEGIN).cast("long").alias("state"), F.lit(int(rows)).cast("long").alias("history"), F.lit(begin_fail).alias("fail"))
    )
    way = F.pow(F.lit(10.0), F.col("fail")) * (F.col("own") + 0.5) / F.lit(model.total + 0.5 * (model.vocabulary + 1))
    late = written(
        low.join(ahead, "state").join(counts.select("word", F.col("n").alias("own")), "word")
        .select(_pair_key().alias("key"), F.log10(((F.col("n") - DISCOUNT) / F.col("history") + way) / way).alias("bonus")), "late-arcs"
    )
    removed(arcs, counts)
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    filled = late.select(F.shiftright(bit, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    filled = filled.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    model.maybe = np.zeros(FILTER_BITS >> 6, np.uint64)
    model.maybe[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return words, late, model


def with_scores(docs: DataFrame, counts: DataFrame, arcs: DataFrame | None, model: Automaton) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of `docs` (columns doc_id, text).

    base_score adds the words' own log10 probabilities, score follows the
    automaton.  Tokens are the words between ASCII white space, A-Z as a-z,
    and one end; a null or empty text is the end alone.  Rare words' root
    and failure arcs come from `counts` by a join on the word, rare pairs' arcs
    from `arcs`, equal ones of a row merged, and are added to the row's sums.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, place long, n_tokens long, n_known long, base double, walk double, rare array<long>, rare_times array<int>"
    parts = range(PAIR_PARTS)
    schema += "".join(f", pairs_{k} array<long>, pair_times_{k} array<int>" for k in parts)
    lists_of = [x.split()[0] for x in schema.split(", ")][6:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for low, high, found in word_pieces(batch.column(2), BETWEEN_SPACES):
                tokens, first = _tokens(found)
                known, base, walk, rare, late = automaton.walk(tokens, first)
                keys = _pair_keys(_before(tokens, first), tokens)
                lists = [x for mask, values in ((rare, tokens), *((late & (_part(keys) == k), keys) for k in parts)) for x in _merged(values, mask, first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(walk), *lists],
                    names=["doc_id", "place", "n_tokens", "n_known", "base", "walk", *lists_of],
                )

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), "text")
    walked = written(placed.mapInArrow(run, schema), "walked")
    listed = lambda values, times, name: walked.select("place", F.inline(F.arrays_zip(values, times))).toDF("place", name, "times")
    single = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.total + 0.5 * (model.vocabulary + 1)))
    # words and the parts of the pairs are summed one after the other: the shuffle files of one are freed before the next makes its own
    late = written(listed("rare", "rare_times", "word").join(counts, "word", "left").groupBy("place").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("late_known"), F.sum(F.col("times") * single).alias("late"),
        # every word is the state of the token behind it; the end has none
        F.sum(F.col("times") * F.when(F.col("word") == _END, 0.0).otherwise(F.coalesce("fail", F.lit(0.0)))).alias("late_fail"),
    ), "late-words")
    shuffles_freed(docs.sparkSession)
    scored = walked.drop(*lists_of).join(late, "place", "left")
    bonus = F.lit(0.0)
    if arcs is not None:
        sums = []
        for k in parts:
            own = arcs.where(F.shiftrightunsigned("key", 48) % PAIR_PARTS == k)
            sums.append(written(listed(f"pairs_{k}", f"pair_times_{k}", "key").join(own, "key").groupBy("place").agg(F.sum(F.col("times") * F.col("bonus")).alias("bonus")), "late-pairs"))
            shuffles_freed(docs.sparkSession)
        taken = reduce(DataFrame.unionByName, sums).groupBy("place").agg(F.sum("bonus").alias("bonus"))
        scored, bonus = scored.join(taken, "place", "left"), F.coalesce("bonus", F.lit(0.0))
    return scored.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("late", F.lit(0.0))).alias("base_score"), (F.col("walk") + F.coalesce(F.col("late") + F.col("late_fail"), F.lit(0.0)) + bonus).alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those outside the held-out fold (crc32 of doc_id modulo 5 is 1); a null id trains and isn't held out."""
    out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    counts, arcs, model = whole_fit(docs.where(~out))
    return with_scores(docs, counts, arcs, model).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
