import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tierlens.llm.spans import ALPHANUMERIC, BETWEEN_SPACES, word_pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ((BETWEEN_SPACES, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé\n \t-|ß0\x0b\x1c", max_size=30)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    for kind, pattern in KINDS:
        got = []
        for _, _, piece in word_pieces(pa.array(texts, pa.string()), kind):
            body = piece.data.tobytes()
            got += [
                [body[a:b].decode() for a, b in zip(piece.start[f:t], piece.end[f:t])] for f, t in zip(piece.first[:-1], piece.first[1:])
            ]
        assert got == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


def test_hashes_depend_on_the_word_alone():
    column = pa.array(["One two", "x two ONE", None, "", "two"])
    seen: dict[str, set[int]] = {}
    for _, _, piece in word_pieces(column, BETWEEN_SPACES):
        body = piece.data.tobytes()
        for a, b, h in zip(piece.start, piece.end, piece.hashes().tolist()):
            seen.setdefault(body[a:b].decode(), set()).add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({h for s in seen.values() for h in s}) == 3


def test_sliced_arrow_columns():
    column = pa.array(["a b", "c", "d e f"]).slice(1)
    (low, high, piece), = word_pieces(column, BETWEEN_SPACES)
    assert (low, high) == (0, 2) and piece.counts.tolist() == [1, 3]
    assert np.all(piece.first == [0, 1, 4])


def test_pieces_take_little_memory_and_give_it_back():
    """A worker stays alive between stages: what its pieces took must not stay with it."""
    code = """
import numpy as np, pyarrow as pa
from tierlens.llm import quality, spans
def now(name):
    with open("/proc/self/status") as lines:
        return next(int(line.split()[1]) // 1024 for line in lines if line.startswith(name))
column = pa.array([" ".join(f"w{(k * 7919 + j) % 5000}" for j in range(2_000)) for k in range(2_000)])
start = now("VmRSS")
for _, _, piece in spans.word_pieces(column, spans.BETWEEN_SPACES):
    piece.hashes()
del piece
for found, hashes, shapes in quality._tokens(column):
    pass
print(now("VmHWM") - start)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 90
