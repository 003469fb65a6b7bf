"""Edit distance, edit-script counts and edit events.

`levenshtein` is built into Spark and used wherever the total is enough.  The
split into substitutions, deletions and insertions needs the dynamic program;
it runs as an Arrow UDF that fills one anti-diagonal at a time for a whole
batch of pairs, so short pairs share the work and long ones stay vectorised.
Ties: match, substitution, deletion, insertion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tierlens.functions.labels import without_whitespace

COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("substitutions", "deletions", "insertions")])
EVENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("op", "reference", "predicted")]
    + [T.StructField(c, T.IntegerType()) for c in ("reference_pos", "predicted_pos")]
)
VERDICT = T.StructType(
    [
        T.StructField("assessment", T.StringType()),
        T.StructField("possible", T.StringType()),
        T.StructField("deletion_possible", T.BooleanType()),
    ]
)
BATCH_CELLS = 4_000_000
# The Arrow UDFs are marked non-deterministic so that they run exactly where
# they are written: otherwise a filter inferred from an explode is pushed with
# the UDF below the distinct that was meant to spare it.


def edit_distance(truth: Column, prediction: Column, ignore_ws: bool = False) -> Column:
    if ignore_ws:
        truth, prediction = without_whitespace(truth), without_whitespace(prediction)
    return F.levenshtein(truth, prediction)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)


def _diagonals(truths: list[np.ndarray], preds: list[np.ndarray], keep_moves: bool = False):
    """Substitution/deletion/insertion counts of a batch; optionally the move table."""
    size_t = np.array([len(t) for t in truths])
    size_p = np.array([len(p) for p in preds])
    n, m, rows = int(size_t.max()), int(size_p.max()), len(truths)
    left = np.full((rows, n), -1, np.int32)
    right = np.full((rows, m), -2, np.int32)
    for k in range(rows):
        left[k, : size_t[k]] = truths[k]
        right[k, : size_p[k]] = preds[k]
    mirrored = right[:, ::-1]
    cost = [np.zeros((rows, n + 1), np.int32) for _ in range(3)]
    ins = [np.zeros((rows, n + 1), np.int32) for _ in range(3)]
    total, inserted = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    moves = np.zeros((n + 1, m + 1), np.uint8) if keep_moves else None
    for d in range(1, n + m + 1):
        cur, one, two = cost[d % 3], cost[(d - 1) % 3], cost[(d - 2) % 3]
        icur, ione, itwo = ins[d % 3], ins[(d - 1) % 3], ins[(d - 2) % 3]
        lo, hi = max(1, d - m), min(d - 1, n)
        if lo <= hi:
            here, above = slice(lo, hi + 1), slice(lo - 1, hi)
            equal = left[:, above] == mirrored[:, m - d + lo : m - d + hi + 1]
            sub, dele, add = two[:, above], one[:, above], one[:, here]
            use_sub = (sub <= dele) & (sub <= add)
            use_del = ~use_sub & (dele <= add)
            best = np.where(use_sub, sub, np.where(use_del, dele, add)) + 1
            cur[:, here] = np.where(equal, sub, best)
            icur[:, here] = np.where(
                equal | use_sub, itwo[:, above], np.where(use_del, ione[:, above], ione[:, here] + 1)
            )
            if keep_moves:
                kind = np.where(equal, 0, np.where(use_sub, 1, np.where(use_del, 2, 3)))
                at = np.arange(lo, hi + 1)
                moves[at, d - at] = kind[0]
        if d <= m:
            cur[:, 0] = icur[:, 0] = d
        if d <= n:
            cur[:, d], icur[:, d] = d, 0
        done = np.flatnonzero(size_t + size_p == d)
        total[done], inserted[done] = cur[done, size_t[done]], icur[done, size_t[done]]
    deleted = inserted + size_t - size_p
    return total - deleted - inserted, deleted, inserted, moves


@F.pandas_udf(COUNTS)
def _edit_counts(truth: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(truth), 3), np.int32)
    null = (truth.isna() | prediction.isna()).to_numpy()
    a = [_codes(t or "") for t in truth.where(~null, "")]
    b = [_codes(p or "") for p in prediction.where(~null, "")]
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    start = 0
    while start < len(order):
        stop, longest = start, 1
        while stop < len(order):
            longest = max(longest, len(a[order[stop]]) + len(b[order[stop]]))
            if stop > start and (stop - start + 1) * longest > BATCH_CELLS:
                break
            stop += 1
        part = order[start:stop]
        s, d, i, _ = _diagonals([a[k] for k in part], [b[k] for k in part])
        out[part] = np.stack([s, d, i], axis=1)
        start = stop
    frame = pd.DataFrame(out, columns=["substitutions", "deletions", "insertions"]).astype("Int32")
    frame[null] = pd.NA
    return frame


def edit_counts(truth: Column, prediction: Column, ignore_ws: bool = False) -> Column:
    """struct<substitutions,deletions,insertions> turning truth into prediction."""
    if ignore_ws:
        truth, prediction = without_whitespace(truth), without_whitespace(prediction)
    return _edit_counts.asNondeterministic()(truth, prediction)


#: Cells of a pair's table that are kept whole; longer pairs keep every so manieth row and redo the rows between.
WHOLE_TABLE_CELLS = 1_000_000


def _next_row(row: np.ndarray, code: int, columns: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """Distances of one more character of the first text to all prefixes of the second."""
    step = np.empty_like(row)
    step[0] = row[0] + 1
    np.minimum(row[:-1] + (columns != code), row[1:] + 1, out=step[1:])
    return np.minimum.accumulate(step - ramp) + ramp


def _row_moves(above: np.ndarray, here: np.ndarray, code: int, columns: np.ndarray) -> np.ndarray:
    """Move into each place of a row: 0 match, 1 substitution, 2 deletion, 3 insertion."""
    sub, dele, add = above[:-1], above[1:], here[:-1]
    use_sub = (sub <= dele) & (sub <= add)
    moves = np.where(columns == code, 0, np.where(use_sub, 1, np.where(dele <= add, 2, 3))).astype(np.uint8)
    return np.concatenate([np.array([2], np.uint8), moves])


def _trace(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(move, i, j) from the end to the start of two texts, in memory of about 2 * sqrt(len(a)) * len(b) bytes.

    Rows of the table differ by at most one from place to place, so a kept
    row is its first value and a byte per place.
    """
    n, m = len(a), len(b)
    ramp = np.arange(m + 1, dtype=np.int32)
    every = max(1, int(np.sqrt(n)))
    kept, row = [], ramp.copy()
    for i in range(n):
        if i % every == 0:
            kept.append((int(row[0]), np.diff(row).astype(np.int8)))
        row = _next_row(row, a[i], b, ramp)
    out, i, j = [], n, m
    while i:
        block = (i - 1) // every
        start, (first, steps) = block * every, kept[block]
        row = np.concatenate([[first], first + np.cumsum(steps[:j], dtype=np.int32)]).astype(np.int32)
        moves, part = [], ramp[: j + 1]
        for k in range(start, i):
            below = _next_row(row, a[k], b[:j], part)
            moves.append(_row_moves(row, below, a[k], b[:j]))
            row = below
        while i > start:
            kind = int(moves[i - 1 - start][j])
            out.append((kind, i, j))
            i, j = i - (kind != 3), j - (kind != 2)
        kept.pop()
    out += [(3, 0, k) for k in range(j, 0, -1)]
    return out


def _script(truth: str, prediction: str) -> list[dict]:
    a, b = _codes(truth), _codes(prediction)
    while len(a) and len(b) and a[-1] == b[-1]:     # a shared end is always matched
        a, b = a[:-1], b[:-1]
    if not len(a) and not len(b):
        return []
    if len(a) and len(b) and len(a) * len(b) <= WHOLE_TABLE_CELLS:
        moves = _diagonals([a], [b], keep_moves=True)[3]
        steps, i, j = [], len(a), len(b)
        while i or j:
            kind = 3 if not i else 2 if not j else int(moves[i, j])
            steps.append((kind, i, j))
            i, j = i - (kind != 3), j - (kind != 2)
    else:
        steps = _trace(a, b)
    events = [
        dict(
            op="MSDI"[kind], reference=chr(a[i - 1]) if kind != 3 else "", predicted=chr(b[j - 1]) if kind != 2 else "",
            reference_pos=i - (kind != 3), predicted_pos=j - (kind != 2),
        )
        for kind, i, j in steps if kind
    ]
    return events[::-1]


@F.pandas_udf(T.ArrayType(EVENT))
def _edit_events(truth: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or p is None else _script(t, p) for t, p in zip(truth, prediction)])


def edit_events(truth: Column, prediction: Column, ignore_ws: bool = False) -> Column:
    """Array of edits in text order: op S, D or I, characters and positions."""
    if ignore_ws:
        truth, prediction = without_whitespace(truth), without_whitespace(prediction)
    return _edit_events.asNondeterministic()(truth, prediction)


def _truth_options(raw: str, truth: str, index: int) -> tuple[set[str], bool]:
    """Truth characters that position `index` of raw meets over all minimum edits."""

    def last_row(x: str, y: str) -> np.ndarray:
        ys, ramp = _codes(y), np.arange(len(y) + 1, dtype=np.int32)
        row = ramp.copy()
        for code in _codes(x):
            row = _next_row(row, code, ys, ramp)
        return row

    head = last_row(raw[:index], truth)
    tail = last_row(raw[index + 1 :][::-1], truth[::-1])[::-1]
    differs = (_codes(truth) != ord(raw[index])).astype(np.int32)
    paired = head[:-1] + differs + tail[1:]
    dropped = head + 1 + tail
    best = min(int(paired.min()) if len(truth) else dropped.min(), int(dropped.min()))
    return {truth[k] for k in np.flatnonzero(paired == best)}, bool((dropped == best).any())


@F.pandas_udf(VERDICT)
def _assess(raw: pd.Series, truth: pd.Series, index: pd.Series, replacement: pd.Series) -> pd.DataFrame:
    rows = []
    for r, t, k, new in zip(raw, truth, index, replacement):
        chars, gone = _truth_options(r, t, int(k)) if t is not None else (set(), True)
        verdict = "uncertain_alignment"
        if len(chars) == 1 and not gone:
            verdict = "correct" if new in chars else "incorrect"
        rows.append((verdict, "".join(sorted(chars)), gone))
    return pd.DataFrame(rows, columns=["assessment", "possible", "deletion_possible"])


def assess_correction(raw: Column, truth: Column, index: Column, replacement: Column) -> Column:
    """Is a one-character correction right under every minimum-edit alignment?"""
    return _assess.asNondeterministic()(raw, truth, index, replacement)
