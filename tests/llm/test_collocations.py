import random
import re
from collections import Counter

import numpy as np
import pytest
from awkward_tables import awkward, empty, with_clashes

from tierlens.llm import collocations
from tierlens.llm.double_array import DoubleArray

DOCS = "doc_id long, text string, lang string"


def brute(rows, least, top):
    totals, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, seen in counts.items():
        often = {p: a for p, a in seen.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
            if any(len(q) > len(p) and inside(q) and 100 * b >= 80 * a for q, b in often.items()):
                continue
            score, _, l, r = min((2000000 * a // (seen[p[:k]] + seen[p[k:]]), k, seen[p[:k]], seen[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    said = ["new york city", "of the people", "a b a b a", "Ça va bien", "the the the the"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(25)):
            words.append(rng.choice(said) if rng.random() < 0.4 else f"w{rng.randrange(12)}")
            words.append(rng.choice((" ", " ", "  ", ". ", ", ", "\n", "\t", "! ", "")))
        out.append((rng.choice(("en", "en", "en", "fr", None, "und")), " ".join(words)))
    return out


@pytest.mark.parametrize("phrases", [0, 7, 1 << 17])
def test_same_as_brute_force_whatever_the_trie_holds(spark, monkeypatch, phrases):
    monkeypatch.setattr(collocations, "TRIE_PHRASES", phrases)
    rows = texts(3)
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=25).collect())
    assert got == brute(rows, 4, 25)


def test_hot_phrases_broadcast_or_joined_are_the_same(spark, monkeypatch):
    rows = texts(4)
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], DOCS)
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.02)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=400).collect())
    assert got == brute(rows, 5, 400)


def test_awkward_rows(spark):
    docs = with_clashes(awkward(spark), "word", "rank", "phrase", "n", "key")
    rows = [(r["lang"], r["text"]) for r in awkward(spark).collect()]
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=50).collect())
    assert got == brute(rows, 4, 50)
    assert collocations.collocations(empty(spark)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5_000_000_000_000
    row = spark.range(1).selectExpr(f"cast({big} as bigint) a", f"cast({big + 1} as bigint) l")
    got = row.selectExpr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(a as decimal(20, 0)) + l) as bigint) s").first()["s"]
    assert got == 2000000 * big // (2 * big + 1)


def test_double_array_knows_its_phrases_and_no_others():
    rng = random.Random(1)
    phrases = {tuple(rng.randrange(1, 40) for _ in range(rng.randint(1, 4))) for _ in range(900)}
    table = np.zeros((len(phrases), 4), np.uint64)
    lengths = np.array([len(p) for p in sorted(phrases)])
    for row, p in zip(table, sorted(phrases)):
        row[: len(p)] = [x * 1_000_003 for x in p]
    trie = DoubleArray(table, lengths)
    known = {p[:k] for p in phrases for k in range(1, 5)}
    text = np.array([rng.randrange(1, 44) * 1_000_003 for _ in range(5000)], np.uint64)
    codes = trie.codes(text)
    state = np.zeros(len(text) - 3, np.int64)
    for k in range(4):
        state = trie.step(state, codes[k : k + len(state)])
        want = np.array([tuple(int(x) // 1_000_003 for x in text[i : i + k + 1]) in known for i in range(len(state))])
        assert (want == (state >= 0)).all()
    assert len(set(trie.end.tolist())) == len(phrases)


def test_an_empty_trie_accepts_nothing():
    trie = DoubleArray(np.zeros((0, 4), np.uint64), np.zeros(0, np.int64))
    codes = trie.codes(np.array([5, 6], np.uint64))
    assert trie.step(np.zeros(2, np.int64), codes).tolist() == [-1, -1]
