"""Verdicts of aligned rows as an Arrow UDF: a whole batch of candidates at once.

The search of operators/alignment tries many offsets per row.  The UDF finds
the runs of all candidates of a batch together, with the rules of
operators/policy.aligned_runs and aligned_verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from tierlens.functions import notation as N

#: Characters of candidates that are judged together.
BATCH_CHARACTERS = 4_000_000
CODES = (
    "ALIGNED_CANONICAL_OK", "SYMBOL_POSITION_CONTRADICTION", "AMBIGUOUS_NOTATION", "WRONG_SYMBOL_DIRECTION", "NONCANONICAL_COUNT_TOKEN",
    "ADJACENT_IDENTICAL_RUNS", "NONCANONICAL_ALIGNMENT", "MISSING_ALIGNED_SYMBOL",
)
VERDICT = T.StructType([T.StructField("code", T.StringType()), T.StructField("row_total", T.IntegerType()), T.StructField("reading", T.StringType())])
_BLANK, _OTHER = 32, 128


def _table(alphabet: str, step: int = 0) -> np.ndarray:
    """Per character its place in the alphabet times `step` (1 without a step), 0 elsewhere."""
    out = np.zeros(256, np.int32)
    for k, char in enumerate(alphabet):
        out[ord(char)] = (k + 1) * step or 1
    return out


_UP, _DOWN, _UNIT, _TEN = _table(N.UP_SYMBOLS), _table(N.DOWN_SYMBOLS), _table(N.UNIT_GLYPHS, 1), _table(N.TEN_GLYPHS, 10)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per character, _OTHER for those that stand in no alphabet, and the place of each text's first one (one more entry)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    leads = (raw & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(leads)])[at - at[0]]
    chars = raw[leads]
    return np.where((chars == 0) | (chars > 127), np.uint8(_OTHER), chars), first


def _joined(symbols: np.ndarray, tokens: np.ndarray, glyphs: np.ndarray, lengths: np.ndarray, row: np.ndarray, rows: int, wanted: np.ndarray) -> pa.Array:
    """Per wanted row its runs' symbols, each followed by its token of one or two glyphs; null elsewhere."""
    kept = wanted[row]
    size = 1 + lengths[kept]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[at] = symbols[kept]
    out[at + 1] = glyphs[tokens[kept]]
    long = size == 3
    out[at[long] + 2] = glyphs[tokens[kept][long] + 1]
    first = np.concatenate([[0], np.cumsum(np.bincount(row[kept], weights=size, minlength=rows))]).astype(np.int32)
    valid = np.packbits(wanted, bitorder="little")
    return pa.StringArray.from_buffers(rows, pa.py_buffer(first), pa.py_buffer(out), pa.py_buffer(valid))


def _judged(u: pa.Array, c: pa.Array, l: pa.Array, u_at: np.ndarray, l_at: np.ndarray, tested: np.ndarray) -> pa.StructArray:
    (upper, u_first), (count, c_first), (lower, l_first) = _characters(u), _characters(c), _characters(l)
    u_size, c_size, l_size = np.diff(u_first), np.diff(c_first), np.diff(l_first)
    rows = len(tested)
    width = np.maximum(np.where(u_size > 0, u_size + u_at, 0), np.where(l_size > 0, l_size + l_at, 0))
    base = np.concatenate([[0], np.cumsum(width)])
    tiers = []
    for chars, first, size, shift in ((upper, u_first, u_size, u_at), (lower, l_first, l_size, l_at)):
        drawn = np.zeros(base[-1], np.uint8)
        drawn[np.repeat(base[:-1] + shift - first[:-1], size) + np.arange(len(chars))] = np.where(chars == _BLANK, np.uint8(0), chars)
        tiers.append(drawn)
    place = np.flatnonzero(tiers[0] | tiers[1])
    row = np.repeat(np.arange(rows), width)[place]
    start = place - base[row]
    up, down = tiers[0][place], tiers[1][place]
    symbol = np.where(up > 0, up, down)
    follows = np.zeros(len(row), bool)
    follows[1:] = row[1:] == row[:-1]
    stop = c_size[row]
    stop[:-1][follows[1:]] = start[1:][follows[1:]]
    # tokens: from the symbol's column to the next one's, without the blanks in front
    inked = np.append(np.where(count == _BLANK, len(count), np.arange(len(count))), len(count))
    inked = np.minimum.accumulate(inked[::-1])[::-1]
    begin = c_first[row] + np.minimum(start, c_size[row])
    end = c_first[row] + np.minimum(stop, c_size[row])
    token = np.minimum(inked[begin], end)
    length = end - token
    glyphs = np.append(count, np.zeros(2, np.uint8))
    one, two = glyphs[token], glyphs[token + 1]
    double = (length == 2) & (_TEN[one] > 0) & (_UNIT[two] > 0)
    value = np.where(length == 1, _UNIT[one] + _TEN[one], np.where(double, _TEN[one] + _UNIT[two], 0))
    again = follows.copy()
    again[1:] &= symbol[1:] == symbol[:-1]
    fault = np.select(
        [(up > 0) & (down > 0), symbol == ord(N.AMBIGUOUS_SYMBOLS), np.where(up > 0, _UP[symbol], _DOWN[symbol]) == 0, value == 0, again], [1, 2, 3, 4, 5], 0
    )
    code = np.zeros(rows, np.int64)
    # without a fault the tokens cover the count tier and the symbols stand on their own tiers: the drawing differs by blanks only
    code[row[token > begin]] = 6
    for chars, first, size in ((upper, u_first, u_size), (lower, l_first, l_size)):
        some = np.flatnonzero(size)
        code[some[chars[first[some + 1] - 1] == _BLANK]] = 6
    at_fault = np.flatnonzero(fault)[::-1]  # the first one of a row is written last
    code[row[at_fault]] = fault[at_fault]
    missing = np.ones(rows, bool)
    missing[row[~follows]] = start[~follows] != 0
    code[missing] = 7
    accepted = tested & (code == 0)
    total = np.bincount(row, weights=value, minlength=rows).astype(np.int32)
    return pa.StructArray.from_arrays(
        [
            pa.array(CODES).take(pa.array(code, mask=~tested)), pa.array(total, mask=~accepted),
            _joined(symbol, token, glyphs, length, row, rows, accepted),
        ],
        names=["code", "row_total", "reading"],
    )


@F.arrow_udf(VERDICT)
def _verdicts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for u, c, l, u_at, l_at in batches:
        tested = u_at.is_valid().to_numpy(zero_copy_only=False)
        shifts = [pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (u_at, l_at)]
        sizes = sum((pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (u, c, l)), sum(shifts))
        done = np.concatenate([[0], np.cumsum(sizes)])
        parts, at = [], 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(done, done[at] + BATCH_CHARACTERS, "right")) - 1)
            parts.append(_judged(*[x.slice(at, to - at) for x in (u, c, l)], shifts[0][at:to], shifts[1][at:to], tested[at:to]))
            at = to
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("code", pa.string()), ("row_total", pa.int32()), ("reading", pa.string())]))


def aligned_verdicts(upper: Column, count: Column, lower: Column, upper_offset: Column, lower_offset: Column) -> Column:
    """struct<code,row_total,reading> of a row whose non-empty symbol tiers start at these offsets.

    The tiers are neither null nor blank, their ends lie within the count
    tier; total and reading are null unless the row is canonical, everything
    is null without offsets.
    """
    return _verdicts.asNondeterministic()(upper, count, lower, upper_offset, lower_offset)
