import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from awkward_tables import DOCS, awkward, awkward_rows, empty, prose, with_clashes

from tierlens.llm import lm, quality
from tierlens.llm.spans import BETWEEN_SPACES, word_pieces
from tierlens.session import checkpoint_dir

LABELS = "doc_id long, quality int, toxic int"


def labelled(n=400, seed=3):
    """Half prose, half shouting or markup, with labels."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        words = prose(rng, rng.randrange(20, 120)).split(" ")
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["$$$", "***", " |"]) for w in words]
        docs.append((k, " ".join(words), "en", "s", None))
        labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = labelled()
    got = quality.quality_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(-math.log(max(1e-9, r["score"] if truth[r["doc_id"]] else 1 - r["score"])) for r in held) / len(held) < 0.3


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(160)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in quality.quality_scores(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_awkward_tables_score(spark):
    rows = [r for r in awkward_rows() if r[0] != 5]
    docs = with_clashes(spark.createDataFrame(rows, DOCS), "score", "_whole_text", "label", "pick")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (100, 1, 0), (101, 0, 0), (101, 0, 0), (999, 1, 1)], LABELS)
    got = quality.quality_scores(spark, docs, labels).collect()
    assert len(got) == len(rows) and {r["score"] for r in got if r["doc_id"] == 2} == {r["score"] for r in got if r["doc_id"] == 3}
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert quality.quality_scores(spark, empty(spark), labels).count() == 0


def test_no_labels_give_a_half(spark):
    got = quality.quality_scores(spark, awkward(spark).where("doc_id < 5"), spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {0}


def test_context_sums_equal_a_plain_loop():
    texts = ["a b c a d", "b", "", "a a b"]
    for _, _, found in word_pieces(pa.array(texts), BETWEEN_SPACES):
        names, counts, sums = quality._contexts(found.hashes(), found.rows())
        hashes = found.hashes().tolist()
    want, seen, at = {}, collections.Counter(hashes), 0
    for text in texts:
        n = len(text.split())
        row = hashes[at : at + n]
        at += n
        for i, h in enumerate(row):
            for j in range(max(0, i - quality.REACH), min(n, i + quality.REACH + 1)):
                if j != i:
                    want[h] = want.get(h, 0) + quality._index_vectors(np.array([row[j]], np.uint64))[0]
    for name, count, vector in zip(names.tolist(), counts.tolist(), sums):
        assert count == seen[name] and np.array_equal(vector, want.get(name, np.zeros(quality.DIM)))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(n_tokens, n_known, base, score) of every row by a plain traversal."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)) + [None] for r in rows]
    train = [t for r, t in zip(rows, tokens) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = collections.Counter(w for t in train for w in t)
    total, vocabulary = sum(count.values()), len(count)
    pairs = collections.Counter(p for t in train for p in zip(["begin!", *t], t))
    states = {w for w in count if count[w] >= total * lm.SHARE}
    arcs = {
        (u, w): n for (u, w), n in pairs.items()
        if n >= max(lm.PAIR_LEAST, total * lm.SHARE) and w in states and (u == "begin!" or u in states)
    }
    history = {**count, "begin!": len(train)}
    kept = collections.Counter()
    for (u, _), n in arcs.items():
        kept[u] += n - lm.DISCOUNT
    single = lambda w: (count[w] + 0.5) / (total + 0.5 * (vocabulary + 1))
    out = []
    for r, t in zip(rows, tokens):
        base = score = 0.0
        state = "begin!"
        for w in t:
            base += math.log10(single(w))
            if state == "begin!" or state in states:
                rest = 1 - kept[state] / history[state]
                score += math.log10((arcs[state, w] - lm.DISCOUNT) / history[state] + rest * single(w) if (state, w) in arcs else rest * single(w))
            else:
                score += math.log10(single(w))
            state = w
        out.append((str(r[0]), len(t), sum(w in count for w in t), round(base, 6), round(score, 6)))
    return sorted(out), total


def rounded(df):
    rows = df.collect()
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows), rows


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-4 and abs(x[4] - y[4]) < 1e-4 for x, y in zip(a, b))


def test_scores_equal_a_plain_traversal(spark):
    rows = awkward_rows()
    got, listed = rounded(lm.held_out_scores(with_clashes(spark.createDataFrame(rows, DOCS), "place", "word", "rare")))
    want, total = brute(rows)
    assert close(got, want) and {r["train_tokens"] for r in listed} == {total}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in listed)


def test_rare_words_come_from_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 2e-3)  # most words are rare now
    rows = [r for r in awkward_rows() if r[0] != 5]
    got, _ = rounded(lm.held_out_scores(spark.createDataFrame(rows, DOCS)))
    assert close(got, brute(rows)[0])


def test_the_cache_changes_no_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "CACHE_SHARE", 5e-3)  # most words and pairs come from the tables
    rows = awkward_rows()
    got, _ = rounded(lm.held_out_scores(spark.createDataFrame(rows, DOCS)))
    assert close(got, brute(rows)[0])


def test_a_pair_seen_twice_is_an_arc_in_a_larger_corpus(spark):
    rows = [(None, "x " * 20000, None, None, None) for _ in range(150)] + [(None, "left right", None, None, None)] * 2
    scores = {r["n_tokens"]: r["score"] - r["base_score"] for r in lm.held_out_scores(spark.createDataFrame(rows, DOCS)).collect()}
    scale = 150 * 20001 + 6 + 0.5 * 5
    twice, end = 2.5 / scale, 152.5 / scale
    want = math.log10((1.25 + 1.5 * twice) / 152 / twice) + math.log10((0.625 + 0.375 * twice) / twice) + math.log10((0.625 + 0.375 * end) / end)
    assert abs(scores[3] - want) < 1e-6  # three tokens, each pair seen twice among three million


def test_probabilities_of_a_state_sum_to_one(spark):
    rows = [(k, text, None, None, None) for k, text in enumerate(["a b a b c", "a b", "b a c a b", "c c", "a"])]
    counts, model = lm.fit(spark.createDataFrame(rows, DOCS))
    words = len(model.words)
    alone = 10 ** model.single(model.counts)
    unknown = 10 ** float(model.single(np.array(0)))
    for state in range(words + 1):
        fail = 10 ** (model.fail[state] if state < words else model.begin_fail)
        total = fail * unknown
        for w in range(words):
            at = np.flatnonzero(model.arcs == (state << 32 | w))
            total += 10 ** model.weights[at[0]] if len(at) else fail * alone[w]
        assert abs(total - 1) < 1e-9 or state < words and not model.counts[state]


def test_no_documents(spark):
    assert lm.held_out_scores(empty(spark)).count() == 0


def test_fit_leaves_only_the_tables_of_the_model(spark):
    rows = [(k, f"one two three word{k % 40} word{k % 7}", None, None, None) for k in range(400)]
    before = set(os.listdir(checkpoint_dir(spark)))
    words, late, model = lm.whole_fit(spark.createDataFrame(rows, DOCS))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(checkpoint_dir(spark))) - before}
    assert left <= {"words", "late-arcs"} and "words" in left and words.count() == model.vocabulary


def test_equal_rare_words_and_pairs_of_a_row_are_one_entry():
    values, first = np.array([7, 5, 7, 7, 5, 9], np.uint64), np.array([0, 4, 4, 6])
    names, times = lm._merged(values, np.array([1, 1, 1, 0, 1, 0], bool), first)
    assert names.to_pylist() == [[5, 7], [], [5]] and times.to_pylist() == [[1, 2], [], [1]]


def test_scoring_leaves_no_shuffle_of_the_words_when_pairs_are_summed(spark, monkeypatch):
    monkeypatch.setattr(lm, "CACHE_SHARE", 5e-3)
    freed, wrote = [], []
    monkeypatch.setattr(lm, "shuffles_freed", lambda s: freed.append(len(wrote)))
    real = lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: (wrote.append(name), real(df, name))[1])
    lm.held_out_scores(spark.createDataFrame(awkward_rows(), DOCS)).count()
    tail = 1 + lm.PAIR_PARTS
    assert wrote[-tail - 1 :] == ["walked", "late-words"] + ["late-pairs"] * lm.PAIR_PARTS and freed[-tail:] == list(range(len(wrote) - tail + 1, len(wrote) + 1))
