"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tierlens.llm.common import fold, free_name, id_text, quoted, written
from tierlens.llm.spans import BETWEEN_SPACES, Words, give_back_memory, pieces, text_buffers, words

#: Labelled documents that the classifier is fitted on, at most; picked by a hash of doc_id.
TRAIN_ROWS = 6_000
#: Words that get a learned vector, at most: the most frequent ones of the fitted documents.
MAX_WORDS = 30_000
DIM = 32
#: Non-zero places of an index vector.
SPARSE = 4
#: Words on either side whose index vectors a word's vector sums up.
REACH = 2
HIDDEN = 32
KEEP_AT = 0.7

_BYTES = np.arange(256)
#: Kinds of bytes for word shapes: upper case, lower case and other letters, digits; other signs stand for themselves.
_KIND = np.select(
    [(_BYTES >= 65) & (_BYTES <= 90), ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128), (_BYTES >= 48) & (_BYTES <= 57)], [65, 97, 48], _BYTES
).astype(np.uint8)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (SPARSE each) of the index vectors of some word hashes."""
    shifts = np.arange(SPARSE, dtype=np.uint64) * np.uint64(8)
    part = hashes[:, None] >> shifts
    return (part & np.uint64(DIM - 1)).astype(np.int64), np.where(part & np.uint64(128), 1, -1)


def _index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), DIM), np.int64)
    place, sign = _places(hashes)
    np.add.at(out, (np.arange(len(hashes))[:, None], place), sign)
    return out


def _shapes(found: Words, body: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: kinds of signs with repeats collapsed, as 'Aa.' or 'A!'."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    kind = _KIND[body]
    edge = np.zeros(len(body) + 1, np.int8)
    edge[found.start] += 1
    edge[found.end] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    keep[1:] &= kind[1:] != kind[:-1]
    keep[found.start] = True
    upto = np.cumsum(keep)
    # another seed than the words': a word and a shape never share a vector
    return Words(kind[keep], upto[found.start] - 1, upto[found.end - 1], found.first).hashes() ^ np.uint64(0x5851F42D4C957F2D)


def _tokens(column: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, word hashes, shape hashes) for pieces of a text column."""
    offsets, body = text_buffers(column)
    for low, high in pieces(offsets):
        part = body[offsets[low] : offsets[high]]
        found = words(offsets[low : high + 1], part, BETWEEN_SPACES)
        yield found, found.hashes(), _shapes(found, part)
    give_back_memory()


def _contexts(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their counts and the sums of the index vectors near them in the same row."""
    names, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    sums = np.zeros((len(names), DIM), np.int64)
    place, sign = _places(hashes)
    for step in range(1, min(REACH, len(hashes) - 1) + 1):
        same = np.flatnonzero(row[step:] == row[:-step])
        for centre, near in ((same, same + step), (same + step, same)):
            flat = inverse[centre][:, None] * DIM + place[near]
            sums += np.bincount(flat.ravel(), sign[near].ravel(), sums.size).astype(np.int64).reshape(sums.shape)
    return names, counts, sums


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


@dataclass
class Vectors:
    """Learned word vectors by sorted hash."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))

    def pooled(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean vector of each row's words and the share of them that have none."""
        rows = len(first) - 1
        out = np.zeros((rows, DIM + 1), np.float32)
        if not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.names, hashes), max(0, len(self.names) - 1))
        known = self.names[at] == hashes if len(self.names) else np.zeros(len(hashes), bool)
        full = np.flatnonzero(np.diff(first))
        size = np.diff(first)[full].astype(np.float32)
        vectors = np.zeros((len(hashes), DIM), np.float32)
        vectors[known] = self.table[at[known]]
        out[full, :DIM] = np.add.reduceat(vectors, first[full], axis=0) / size[:, None]
        out[full, DIM] = np.add.reduceat(~known, first[full], dtype=np.int64) / size
        return out


WIDTH = 2 * (DIM + 1) + 3


def _features(column: pa.Array, vectors: Vectors) -> np.ndarray:
    """One row of WIDTH numbers per text: pooled words, pooled shapes, length, share of distinct words, emptiness."""
    out = [np.zeros((0, WIDTH), np.float32)]
    for found, hashes, shapes in _tokens(column):
        counts = found.counts
        row = found.rows()
        order = np.lexsort((hashes, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][fresh], minlength=len(counts)) / np.maximum(counts, 1)
        more = np.stack([np.log1p(counts) / 10, distinct, counts == 0], axis=1).astype(np.float32)
        out.append(np.hstack([vectors.pooled(hashes, found.first), vectors.pooled(shapes, found.first), more]))
    return np.vstack(out)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x.astype(np.float64)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60, batch: int = 128) -> Network:
    """Adam on the log loss; every fifth row is held back to stop early and to fit the temperature.

    Without rows every probability is 0.5.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    if not len(y):
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 0.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    fit_x, fit_y, held_x, held_y = x[~held], y[~held], x[held], y[held]
    mean, scale = fit_x.mean(0), fit_x.std(0) + 1e-3
    rate = np.clip(fit_y.mean(), 0.01, 0.99)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, best_loss = [a.copy() for a in p], np.inf
    z = (fit_x - mean) / scale
    for _ in range(epochs):
        order = rng.permutation(len(fit_y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            inner = z[rows] @ p[0] + p[1]
            hidden = np.maximum(inner, 0)
            error = (_sigmoid(hidden @ p[2] + p[3]) - fit_y[rows]) / len(rows)
            back = np.outer(error, p[2]) * (inner > 0)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
        loss = _loss(net.logits(held_x), held_y) if held.any() else -step
        if loss < best_loss:
            best, best_loss = [a.copy() for a in p], loss
    net = Network(mean, scale, best[0], best[1], best[2], float(best[3]))
    if held.any():
        logits = net.logits(held_x)
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        net.temperature = float(min(tries, key=lambda t: _loss(logits / t, held_y)))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold, picked and ordered by a hash of doc_id.

    Ids labelled both ways, null ids and null labels are left out.
    """
    name = F.col("doc_id")
    plain = (
        labels.where((fold(name, 4) != 2) & F.col("quality").isNotNull()).groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where(F.col("label") == F.col("other"))
        .join(docs.select("doc_id").distinct(), "doc_id")
    )
    picked = plain.select("doc_id", "label", F.md5(id_text(name).cast("binary")).alias("pick")).orderBy("pick").limit(rows)
    return docs.select("doc_id", "text").join(picked, "doc_id")


def word_vectors(sample: DataFrame) -> Vectors:
    """Random-indexing vectors of the most frequent words and shapes of a bounded sample; sums are taken in Spark."""
    schema = "word long, n long, " + ", ".join(f"v{k} long" for k in range(DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, hashes, shapes in _tokens(batch.column(0)):
                row = found.rows()
                for stream in (hashes, shapes):
                    names, counts, sums = _contexts(stream, row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64)), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(DIM))],
                        names=["word", "n", *(f"v{k}" for k in range(DIM))],
                    )

    found = sample.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)])
    rows = found.where("n > 1").orderBy(F.desc("n"), "word").limit(MAX_WORDS).toArrow()
    names = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    sums = np.stack([rows[f"v{k}"].to_numpy() for k in range(DIM)], axis=1).astype(np.float64)
    return Vectors(names[order], _unit(sums[order]))


@dataclass
class Classifier:
    vectors: Vectors
    network: Network


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """The classifier, fitted on at most `rows` labelled documents; what comes to the driver is bounded by `rows` and MAX_WORDS."""
    sample = written(labelled_sample(docs, labels, rows), "labelled-sample")
    vectors = word_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _features(batch.column(2), shared.value)
            kept = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), WIDTH).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["pick", "label", "x"])

    found = sample.select(F.md5(id_text(F.col("doc_id")).cast("binary")).alias("pick"), F.col("label").cast("int").alias("label"), "text")
    got = found.mapInArrow(run, "pick string, label int, x array<float>").toArrow()
    if not got.num_rows:
        return Classifier(vectors, train_network(np.zeros((0, WIDTH)), np.zeros(0)))
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    y = got["label"].to_numpy()
    order = np.lexsort((*x.T[:1], np.array(got["pick"].to_pylist(), "U32")))
    return Classifier(vectors, train_network(x[order], y[order]))


def with_score(docs: DataFrame, model: Classifier, out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the calibrated probability of label 1 for each whole text; null and empty texts get the score of no words.

    Only the text is read for the score.  `keep` names the columns to carry
    along (all by default).  The model goes out by broadcast; its size is
    bounded by MAX_WORDS.
    """
    kept = list(docs.columns) if keep is None else keep
    inner = free_name(docs, "_whole_text")
    source = docs.select(*[F.col(quoted(c)) for c in kept], F.col("text").alias(inner))
    schema = source.drop(inner).withColumn(out, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            score = fitted.network.probabilities(_features(batch.column(batch.num_columns - 1), fitted.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=schema.names)

    return source.mapInArrow(run, schema)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`; a null id is in no fold and not held out."""
    scored = with_score(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that score below KEEP_AT."""
    out = free_name(docs, "score")
    return with_score(docs, fit(docs, labels), out=out).where(F.col(out) >= KEEP_AT).drop(out)
