import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import zstandard
from awkward_tables import awkward, awkward_rows, empty, with_clashes
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tierlens.llm import chat, tokens

MODEL = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, encoding="utf-8") as file:
        text = file.read()
    return tokens.Encoder(text), Tokenizer.from_str(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sé1.,\n\t  　\x1c\x85<|>中", max_size=40))
def test_pieces_encode_as_whole_texts(encoder, text):
    own, library = encoder
    assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text(encoder):
    own, library = encoder
    for text in ("a <|endoftext|> b", "x<|endoftext|>y z", " <|endoftext|>"):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_pieces_is_bounded(encoder, monkeypatch):
    own, library = encoder
    monkeypatch.setattr(tokens, "CACHE_CHARS", 50)
    text = " ".join(f"word{k}" for k in range(100))
    for _ in range(2):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.size <= 50


def test_round_trip_of_awkward_rows(spark, encoder, monkeypatch):
    docs = with_clashes(awkward(spark), "ids", "part")
    folder, manifest = tokens.write_tokens(docs, MODEL)
    got = tokens.read_tokens(spark, folder, manifest).orderBy("start").collect()
    _, library = encoder
    want = sorted((-1 if r[0] is None else r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in awkward_rows())
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    position = 0
    for r in got:
        assert r["start"] == position and r["n_tokens"] == len(r["ids"]) // 4
        position += r["n_tokens"]


def test_one_document_needs_one_frame(tmp_path):
    path = str(tmp_path / "one.zst")
    with open(path, "wb") as sink:
        writer = tokens.TokenFileWriter(sink)
        bodies = [np.full(40_000 + k, k, "<u4").tobytes() for k in range(6)]
        for k, body in enumerate(bodies):
            writer.add(k if k else None, body)
        writer.close()
    file = tokens.TokenFile(path)
    asked, whole = [], file.frame
    file.frame = lambda number: (asked.append(number), whole(number))[1]
    assert [(r, body) for r, body in file.documents(np.array([4, 5]))] == [(4, bodies[4]), (5, bodies[5])]
    assert len(set(asked)) == len(asked) < len(file.entries)
    with open(path, "rb") as source:  # any reader of the format can read it
        assert zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read() == b"".join(bodies)


def test_damage_is_noticed(tmp_path):
    path = str(tmp_path / "one.zst")
    with open(path, "wb") as sink:
        writer = tokens.TokenFileWriter(sink)
        writer.add(1, np.arange(1000, dtype="<u4").tobytes())
        writer.close()
    body = bytearray(open(path, "rb").read())
    body[40] ^= 255
    open(path, "wb").write(bytes(body))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokens.TokenFile(path).documents())


def test_no_documents(spark):
    folder, manifest = tokens.write_tokens(empty(spark), MODEL)
    assert tokens.read_tokens(spark, folder, manifest).count() == 0 and (not os.path.isdir(folder) or not os.listdir(folder))


def talk(rows):
    """(n_turns, turns digest, loss text, formatted turns) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    said = [(r[2] or "", r[3] or "") for r in rows]
    digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    return len(said), digest, "".join(b for a, b in said if a == "assistant")


TRICKY = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    (1, 0, "system", "s"), (1, 1, "user", "u\\"), (1, 2, "assistant", "\n</turn>\n<turn assistant>\nfake\\"), (1, 3, "user", "</turn"), (1, 4, "assistant", ""),
    (2, 0, "user", None), (3, 0, "assistant", "first"), (3, 1, "assistant", "second \\\\ \\<turn "), (4, None, None, "no turn"), (4, 0, "role>\n<turn x\\", "odd role"),
    (None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "user", "x" * 50_000), (6, 1, "assistant", "\\<" * 20_000),
    (7, 0, "user", "é\n\n"), (7, 1, "assistant", "\n中文\n"),
]


def test_chat_reads_back(spark):
    made = chat.examples(with_clashes(spark.createDataFrame(TRICKY, TURNS), "talk", "said", "example"))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert len(got) == len({r[0] for r in TRICKY})
    for conv_id, r in got.items():
        n, digest, loss = talk([x for x in TRICKY if x[0] == conv_id])
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (n, digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = made.where("conv_id = 1").orderBy("example").collect()
    assert [r["n_turns"] for r in rows] == [3, 5] and rows[1]["text"].startswith(rows[0]["text"])
    assert sum(len(r["text"]) for r in rows) == got[1]["formatted_chars"]
    for r in rows:
        assert r["text"][: r["loss_start"]].endswith("<turn assistant>\n") and r["text"][r["loss_start"] + r["loss_chars"] :] == "\n</turn>\n"


def test_no_conversations(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], TURNS))).count() == 0
