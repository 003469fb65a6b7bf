"""Token ids as files of independent zstandard frames with a seek table, written and read by Spark tasks.

A file is a sequence of zstandard frames, each with the little-endian 32-bit
ids of some whole documents, followed by two skippable frames: the directory
(id, length and frame of each document) and the seek table of the public
seekable format (compressed size, raw size and checksum of each frame).  Any
zstandard reader can read the whole file; a reader of one document reads the
tail, then one frame.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from tierlens.llm.common import fresh_path, task_count, written

#: Raw bytes after which a frame ends; a document is never cut.
FRAME_BYTES = 1 << 18
#: Characters of words and pieces whose ids a worker remembers.
CACHE_CHARS = 8_000_000
END_ID = 0
LEVEL = 1

# fixed values of the zstandard format: skippable frames and the seek table's footer
_DIRECTORY_MAGIC = 0x184D2A50
_SEEK_MAGIC = 0x184D2A5E
_FOOTER_MAGIC = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")
_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("tokens", "<u8"), ("frame", "<u4")])


def _byte_signs() -> dict[int, str]:
    """The sign by which byte-level models write each byte: itself where it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a `tokenizers` model, with a bounded memory of words and pieces.

    Byte-level pre-tokenisation puts a cut before every space that a visible
    sign follows, so such texts are encoded from space to space, and pieces
    seen before are looked up.  New pieces of letters, closing signs and single
    line ends are asked of the model part by part; other pieces, texts
    with other spaces and models that cut otherwise go through the library whole.
    """

    _OTHER_SPACES = re.compile(r" (?:\s|\Z)")
    _PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?*$%&#)\"]*)")
    _SIGNS = _byte_signs()

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_space = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.pieces: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.size = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of what pre-tokenisation leaves in one part."""
        signs = part.replace(" ", self._SIGNS[32]) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self._SIGNS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(signs)]).tobytes()

    def _bare(self, part: str) -> bytes:
        """The same for a part without a space before it, remembered."""
        ids = self.bare.get(part)
        if ids is None:
            ids = self.bare[part] = self._part(part)
            self.size += len(part)
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece with the space before it; a single line end is a part of its own."""
        if piece.isalpha():
            return self._part(" " + piece)
        plain = self._PLAIN.fullmatch(piece)
        if plain and plain[1].isalpha():
            return (self.pieces.get(plain[1]) or self._part(" " + plain[1])) + self._bare(plain[2])
        head, *lines = piece.split("\n")
        end = self._bare("\n") if lines and not lines[-1] else b""
        found = [self._PLAIN.fullmatch(line) for line in ([head, *lines[:-1]] if end else [head, *lines])]
        if not all(m and m[1].isalpha() for m in found) or not lines:
            return self._whole(" " + piece)
        rest = [self._bare("\n") + self._bare(m[1]) + (self._bare(m[2]) if m[2] else b"") for m in found[1:]]
        return self._piece(head) + b"".join(rest) + end

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        if not self.by_space or self._OTHER_SPACES.search(text):
            return self._whole(text)
        pieces = text.split(" ")
        known = self.pieces
        found = list(map(known.get, pieces))
        found[0] = self._whole(pieces[0])
        for k in [k for k, ids in enumerate(found) if ids is None]:
            piece = pieces[k]
            if piece not in known:
                known[piece] = self._piece(piece)
                self.size += len(piece)
            found[k] = known[piece]
        out = b"".join(found)
        if self.size > CACHE_CHARS:
            self.pieces.clear()
            self.bare.clear()
            self.size = 0
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    """The worker's encoder for this model; the next task of the worker finds it again."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


class TokenFileWriter:
    def __init__(self, sink):
        self.sink = sink
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[bytes] = []
        self.raw = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids) // 4, len(self.entries)))
        self.open.append(ids)
        self.raw += len(ids)
        if self.raw >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            body = b"".join(self.open)
            frame = self.pack.compress(body)
            self.sink.write(frame)
            self.entries.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
            self.open, self.raw = [], 0

    def close(self) -> None:
        self._end_frame()
        directory = np.array(self.docs, _DOC).tobytes()
        self.sink.write(struct.pack("<II", _DIRECTORY_MAGIC, len(directory)) + directory)
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), 0x80, _FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)
        self.sink.close()


class TokenFile:
    """Reads the tail of a file once, then any document by decompressing its frame alone."""

    def __init__(self, path: str):
        system, place = _file_system(path)
        self.source = system.open_input_file(place)
        size = self.source.size()
        frames, flags, magic = _FOOTER.unpack(self.source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        table = size - _FOOTER.size - frames * _ENTRY.size
        self.entries = list(_ENTRY.iter_unpack(self.source.read_at(frames * _ENTRY.size, table)))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        head = int(self.starts[-1])
        kind, length = struct.unpack("<II", self.source.read_at(8, head))
        if kind != _DIRECTORY_MAGIC:
            raise ValueError(f"{path} has no directory of documents")
        self.docs = np.frombuffer(self.source.read_at(length, head + 8), _DOC)

    def frame(self, number: int) -> bytes:
        packed, raw, checksum = self.entries[number]
        body = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, int(self.starts[number])), max_output_size=raw)
        if len(body) != raw or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return body

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """(row of the directory, ids) of the asked rows (all by default, in order); only their frames are read."""
        rows = np.arange(len(self.docs)) if rows is None else np.sort(rows)
        size = self.docs["tokens"].astype(np.int64) * 4
        upto = np.cumsum(size)
        have, body, base = -1, b"", 0
        for r in rows.tolist():
            number = int(self.docs["frame"][r])
            if number != have:
                have, body = number, self.frame(number)
                first = int(np.searchsorted(self.docs["frame"], number))
                base = int(upto[first] - size[first])
            start = int(upto[r] - size[r]) - base
            yield r, body[start : start + int(size[r])]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Writes the ids of all texts (columns doc_id, text) in ascending doc_id; gives the folder and (part, file, docs, tokens) of its files.

    One range exchange by doc_id, then each task encodes and writes its range;
    `end_id` closes every document.  Rows without an id come first, repeated
    ids stay side by side in any order; a null text is empty.  A file appears under its
    name only when it is complete, and a task that runs again writes the same
    name.  The vocabulary is read on the driver and goes out by broadcast.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _file_system(folder)
        task = TaskContext.get()
        writer = encoder = None
        name = f"part-{task.partitionId():05d}.zst"
        unfinished = f"{place}/.{name}.{task.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    system.create_dir(place)
                    writer, encoder = TokenFileWriter(system.open_output_stream(unfinished)), _encoder(model.value)
                writer.add(doc_id.as_py(), encoder.ids(text.as_py() or "") + end)
        if writer is None:
            return
        writer.close()
        system.move(unfinished, f"{place}/{name}")
        tokens = sum(d[2] for d in writer.docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([tokens], pa.int64())],
            names=["part", "file", "docs", "tokens"],
        )

    ranged = docs.select("doc_id", "text").repartitionByRange(task_count(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return folder, written(ranged.mapInArrow(run, "part int, file string, docs long, tokens long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, ids as bytes; start counts the ids of all documents before it.

    One row per file sets the offsets of files; inside a file the directory does.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{folder}/{row['file']}")
                upto = row["offset"] + np.cumsum(file.docs["tokens"].astype(np.int64))
                ids: list = []
                places: list[int] = []
                held = 0
                for r, body in file.documents():
                    places.append(r)
                    ids.append(body)
                    held += len(body)
                    if held > 8 << 20 or r == len(file.docs) - 1:
                        some = file.docs[places]
                        tokens = some["tokens"].astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some["id"].astype(np.int64), mask=some["known"] == 0), pa.array(upto[places] - tokens), pa.array(tokens), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        ids, places, held = [], [], 0

    return files.repartition(task_count(spark), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


