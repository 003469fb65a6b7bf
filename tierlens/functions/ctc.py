"""Frame paths, vocabulary ids and trainability checks as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tierlens.functions.bind import let
from tierlens.functions.labels import ctc_required, ctc_required_ids
from tierlens.functions.notation import VOCABULARY

UNKNOWN = -1


def characters(text: Column) -> Column:
    """Characters of a text; the empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Vocabulary ids (blank is 0, first character 1); unknown characters give -1."""
    return F.transform(
        characters(text), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(vocabulary)), F.lit(0)), F.lit(UNKNOWN))
    )


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Text of vocabulary ids; blanks and ids outside the vocabulary are skipped."""
    legal = F.filter(ids, lambda i: i.between(1, len(vocabulary)))
    return F.array_join(F.transform(legal, lambda i: F.substr(F.lit(vocabulary), i, F.lit(1))), "")


def ctc_collapse(path: Column, blank: int | str = 0) -> Column:
    """Merge equal neighbours, then drop the blank."""
    kept = lambda x, i: (x != F.lit(blank)) & ((i == 0) | (F.get(path, i - 1) != x))
    return F.filter(path, kept)


def best_path(frames: Column, allowed: Column | None = None) -> Column:
    """Best class per frame of array<array<score>>; first class wins ties.

    `allowed` is an array of class numbers; other classes cannot win.
    """

    def best(frame: Column) -> Column:
        scores = frame
        if allowed is not None:
            scores = F.transform(frame, lambda s, k: F.when(F.array_contains(allowed, k), s))
        return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

    return F.transform(frames, best)


def greedy_decode(frames: Column, allowed: Column | None = None, blank: int = 0) -> Column:
    return let(best_path(frames, allowed), lambda path: ctc_collapse(path, blank))


def run_starts(path: Column) -> Column:
    """0-based places at which a run of equal values begins."""
    return F.filter(F.transform(path, lambda x, i: F.when((i == 0) | (F.get(path, i - 1) != x), i)), lambda i: i.isNotNull())


def path_stats(path: Column, blank: int | str = 0) -> Column:
    """Frame counts of a path: blanks, repeats, non-blank runs, longest run."""

    def longest(p: Column) -> Column:
        return let(
            run_starts(p),
            lambda s: F.array_max(F.zip_with(F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(F.size(p))), s, lambda e, b: e - b)),
        )

    def stats(p: Column) -> Column:
        size = F.size(p)
        blanks = F.size(F.filter(p, lambda x: x == F.lit(blank)))
        repeated = F.size(F.filter(p, lambda x, i: (i > 0) & (F.get(p, i - 1) == x) & (x != F.lit(blank))))
        return F.struct(
            size.alias("frames"),
            blanks.alias("blank_frames"),
            F.try_divide(blanks.cast("double"), size.cast("double")).alias("blank_fraction"),
            repeated.alias("repeated_nonblank_frames"),
            (size - blanks - repeated).alias("nonblank_runs"),
            F.when(size > 0, longest(p)).otherwise(0).alias("longest_run"),
        )

    return let(path, stats)


def frame_entropy(frame: Column) -> Column:
    """Entropy in nats of one frame of probabilities."""
    return F.aggregate(frame, F.lit(0.0), lambda a, p: a - p * F.log(F.greatest(p, F.lit(1e-30))))


def softmax(frame: Column) -> Column:
    exps = let(F.array_max(frame), lambda top: F.transform(frame, lambda x: F.exp((x - top).cast("double"))))
    share = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return let(exps, share)


def ctc_text_problems(text: Column, steps: Column, vocabulary: str = VOCABULARY) -> Column:
    """`ctc_problems` of the ids that `encode` gives a text, found on the text itself.

    Nothing is evaluated per character: characters outside the vocabulary,
    which share one id, become one character that it lacks.
    """
    stray = next(chr(k) for k in range(1, 0xD800) if chr(k) not in vocabulary)
    foreign = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in vocabulary) + "]" if vocabulary else "(?s)."
    merged = F.regexp_replace(text, foreign, stray)
    filled = F.length(text) > 0
    return let(
        merged,
        lambda m: F.array_compact(
            F.array(
                F.when(F.length(text) == 0, "empty_target"),
                F.when(filled & F.contains(m, F.lit(stray)), "id_out_of_range"),
                F.when(filled & (steps < ctc_required(m)), "too_few_steps"),
            )
        ),
    )


def ctc_problems(ids: Column, steps: Column, vocabulary_size: int, blank: int = 0) -> Column:
    """Names of everything that makes a target untrainable."""
    empty = F.size(ids) == 0
    return F.array_compact(
        F.array(
            F.when(empty, "empty_target"),
            F.when(~empty & F.array_contains(ids, blank), "contains_blank"),
            F.when(~empty & F.exists(ids, lambda t: (t < 0) | (t >= vocabulary_size)), "id_out_of_range"),
            F.when(~empty & (steps < ctc_required_ids(ids)), "too_few_steps"),
        )
    )
