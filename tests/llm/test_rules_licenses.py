import collections
import re

import numpy as np
from awkward_tables import DOCS, awkward, awkward_rows, empty, with_clashes

from tierlens.llm import licenses, rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    repeated = {p for places in windows.values() if len(places) > 1 for k in places for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def repeat_rows():
    rows = awkward_rows()
    rows += [
        (300, "a b c a b c", None, None, None), (301, "a a a a", None, None, None), (302, "x y z\n" * 500, None, None, None),
        (303, "p q r s p q r t p q", None, None, None), (304, "one two three four one two", None, None, None),
    ]
    return rows


def test_counts_equal_brute_force(spark):
    rows = repeat_rows()
    got = rules.judged(spark.createDataFrame(rows, DOCS), keep=["doc_id"])
    want = sorted(((r[0], *counts(r[1])) for r in rows), key=str)
    out = got.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out), key=str) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1


def expectation_maximisation(votes, rounds=rules.ROUNDS):
    """Posterior of each row of the vote matrix, over rows instead of patterns."""
    good = np.where((votes == -1).any(1), 0.1, 0.9)
    for _ in range(rounds):
        n, g = len(votes), good.sum()
        odds = np.full(len(votes), np.log(((g + 1) / (n + 2)) / (1 - (g + 1) / (n + 2))))
        for column in votes.T:
            for value in (-1, 0, 1):
                at = column == value
                odds[at] += np.log(((good[at].sum() + 1) / (g + 3)) / (((1 - good[at]).sum() + 1) / (n - g + 3)))
        good = 1 / (1 + np.exp(-odds))
    return good


def test_posteriors_equal_brute_force(spark):
    votes = rules.with_votes(rules.with_counts(spark.createDataFrame(repeat_rows(), DOCS), keep=["doc_id"]))
    got = votes.withColumn("posterior", rules.fit_posterior(votes)).collect()
    want = expectation_maximisation(np.array([[r[v] for v in rules.VOTES] for r in got]))
    assert np.allclose([r["posterior"] for r in got], want, atol=1e-9)


def test_junk_goes_and_prose_stays(spark):
    prose = [(k, " ".join(f"word{k}x{j} of" for j in range(60)), None, None, None) for k in range(80)]
    junk = [(1000 + k, " ".join(f"w{k}{j}$$$ |" for j in range(60)), None, None, None) for k in range(6)]
    junk += [(2000 + k, " ".join(f"SHOUT{k}{'ABCDEFGH'[j % 8]}{j}!!" for j in range(90)), None, None, None) for k in range(6)]
    got = {r["doc_id"]: r["kept"] for r in rules.judged(spark.createDataFrame(prose + junk, DOCS)).collect()}
    assert all(kept == (doc_id < 1000) for doc_id, kept in got.items())


def test_rules_take_awkward_tables(spark):
    docs = with_clashes(awkward(spark), "N_words", "kept", "posterior", "_filled_lines", "grams", "vote_length")
    got = rules.judged(docs)
    assert got.count() == len(awkward_rows()) and set(rules.BASE) <= set(got.columns) and "grams" in got.columns
    assert rules.judged(empty(spark)).count() == 0


def phrases(text):
    words = re.findall(licenses.WORD_ALNUM, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split(" ")
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), found


def license_rows():
    rows = awkward_rows()
    rows += [
        (400, "MIT License. mit license mit licensE", None, None, None), (401, "Mit\nLICENSE, general public license general public License", None, None, None),
        (402, "This is licensed under the fine Apache License, Version 2.0.", None, None, None), (403, "mit and license", None, None, None),
        (403, "mit license", None, None, None), (None, "apache license", None, None, None), (404, "Licensed under CC BY-NC 4.0.", None, None, None),
        (405, "all rights reserved apache licence", None, None, None), (406, "Émit license xmit license", None, None, None),
    ]
    return rows


def test_base_places_equal_brute_force(spark):
    rows = license_rows()
    got = licenses.license_report(spark.createDataFrame(rows, DOCS)).collect()
    want = []
    for doc_id, text, *_ in rows:
        n, found = phrases(text)
        starts = [k for k, _ in found]
        want.append((doc_id, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))))
    key = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[k] for k in key) for r in got), key=str) == sorted(want, key=str)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[402] == "apache,apache-2.0" and labels[404] == "cc-by-nc-4.0" and labels[405] == "all-rights-reserved" and labels[1] == ""


def test_spans_stand_where_they_say(spark):
    got = licenses.license_spans(spark.createDataFrame(license_rows(), DOCS).where("doc_id = 402"))
    assert {(r["label"], r["start"], r["words"]) for r in got.collect()} == {("apache", 6, 2), ("apache-2.0", 2, 9)}


def test_texts_without_key_words_go_first_and_the_others_are_read_once(spark):
    keys = licenses.key_words()
    for number, (words, _) in enumerate((*licenses.PHRASES, *licenses.NOTICES)):
        w = words.split(" ")
        left = [(a, b) for a, b in zip(w, w[1:]) if not any(key in a or key in b for key in keys)]
        assert len(left) < (1 if number < len(licenses.PHRASES) else licenses.COVER) * (len(w) - 1)
    plan = licenses.license_spans(spark.createDataFrame(license_rows(), DOCS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" split(") + plan.count("(split(") == 1 and all(f", {key})" in plan for key in keys)


def test_every_notice_is_found_with_a_word_in_capitals_or_left_out(spark):
    rows, want = [], set()
    for k, (notice, label) in enumerate(licenses.NOTICES):
        words = notice.split(" ")
        for j in range(-1, len(words)):
            text = "x " + " ".join(w.upper() if i % 2 else w for i, w in enumerate(words) if i != j) + " y"
            rows.append((100 * k + j + 1, text, None, None, None))
            there = sum(i not in (j - 1, j) for i in range(len(words) - 1))
            want |= {(100 * k + j + 1, label)} if there >= licenses.COVER * (len(words) - 1) else set()
    got = licenses.license_spans(spark.createDataFrame(rows, DOCS)).where("NOT exact").collect()
    assert want <= {(r["doc_id"], r["label"]) for r in got}


def test_license_tables(spark):
    assert licenses.license_report(empty(spark)).count() == 0
    assert licenses.license_report(with_clashes(awkward(spark), "gram", "place", "text_hash", "label")).count() == len(awkward_rows())
