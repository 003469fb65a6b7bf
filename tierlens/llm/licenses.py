"""Licence scans by diagonal voting: rolling word hashes meet template positions, diagonals gather votes, spans are verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tierlens.llm.common import lower_ascii

#: Words of a rolling hash.
GRAM = 2
#: Diagonals this far apart are merged: words put in or left out.
NEAR = 2
#: Share of a template's word pairs that a span must have.
COVER = 0.85
WORD_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words: all other ASCII characters.  To split here is several times as fast as to extract what WORD_ALNUM matches.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose exact places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of licence notices, with their labels.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("all rights reserved", "all-rights-reserved"),
)


def template_rows() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, exact, number of pairs, place, first word, second word) for every word pair of every template."""
    out = []
    for number, (words, label) in enumerate((*PHRASES, *NOTICES)):
        w = words.split(" ")
        out += [(number, label, number < len(PHRASES), len(w) - 1, j, w[j], w[j + 1]) for j in range(len(w) - 1)]
    return out


def templates(spark: SparkSession) -> DataFrame:
    """The pairs of all templates with their hashes: a fixed, small table (some hundred rows)."""
    rows = spark.createDataFrame(template_rows(), "template int, label string, exact boolean, pairs int, at int, a string, b string")
    return rows.select("template", "label", "exact", "pairs", "at", F.xxhash64("a", "b").alias("gram"))


def key_words() -> list[str]:
    """Words of which every text with a span holds one at least: a template keeps too few of its pairs without them."""
    chosen: list[str] = []
    for number, (words, _) in enumerate((*PHRASES, *NOTICES)):
        w = words.split(" ")
        left = [(a, b) for a, b in zip(w, w[1:]) if not any(key in a or key in b for key in chosen)]
        least = (1 if number < len(PHRASES) else COVER) * (len(w) - 1)
        while len(left) >= least:
            chosen.append(max((x for pair in left for x in pair), key=len))
            left = [(a, b) for a, b in left if chosen[-1] not in a and chosen[-1] not in b]
    return chosen


def _may_have_spans(text: Column) -> Column:
    """Whether any key word occurs, be it inside another word; null holds none."""
    small = F.lower(text)
    return reduce(Column.__or__, [small.contains(key) for key in key_words()])


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def _key(docs: DataFrame) -> list[Column]:
    """Rows alike in id and text have the same spans and are looked at as one."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def license_spans(docs: DataFrame) -> DataFrame:
    """Verified spans: (doc_id, text_hash, label, exact, start, words, coverage), words counted from 0.

    Texts without any key word of the templates can't have a span and go
    first.  Every pair of neighbouring words is hashed and joined to the
    template pairs; a hit votes for the diagonal (document place minus template place).
    A phrase stands where its diagonal has all its pairs.  For notices,
    diagonals up to NEAR apart are merged, and the span counts if the merged
    votes cover COVER of the template.  Hits are few; what is grouped is the
    hits of one text.  A null text has no words.
    """
    known = templates(docs.sparkSession)
    listed = docs.where(_may_have_spans(F.col("text"))).select(*_key(docs), _words(lower_ascii(F.col("text"))).alias("w"))
    w = F.col("w")
    pairs = F.when(F.size(w) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    rolling = listed.select("doc_id", "text_hash", F.posexplode(pairs).alias("place", "gram"))
    hits = rolling.join(F.broadcast(known), "gram")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))
    votes = hits.groupBy("doc_id", "text_hash", "template", "label", "exact", "pairs", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(one).alias("voted"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    # a phrase's diagonal is a run of its own; both kinds share the window, so texts are read once
    line = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEAR, F.lit(True))
    return (
        votes.withColumn("fresh", apart.cast("int")).withColumn("run", F.sum("fresh").over(line))
        .groupBy("doc_id", "text_hash", "template", "label", "exact", "pairs", "run")
        .agg(F.bit_or("voted").alias("voted"), F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + GRAM).alias("stop"))
        .withColumn("coverage", F.bit_count("voted") / F.col("pairs")).where(F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(COVER))
        .select("doc_id", "text_hash", "label", "exact", F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("words"), "coverage")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the exact places of PHRASES and first_word and last_word are
    the smallest and largest (null without any); labels joins those of all
    verified spans, sorted; score is the largest coverage, 0 without spans.
    """
    spans = license_spans(docs)
    base = F.col("exact")
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    ).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = docs.select(*_key(docs), F.size(_words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def spans_sql() -> str:
    """The spans as SQL (for the oracle)."""
    values = ",\n".join(f"({t}, '{label}', {str(exact).lower()}, {pairs}, {j}, '{a} {b}')" for t, label, exact, pairs, j, a, b in template_rows())
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t(template, label, exact, pairs, j, gram) AS (VALUES {values}),
g AS (SELECT doc_id, i - 1 AS p, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 1)),
v AS (
  SELECT doc_id, template, label, exact, pairs, p - j AS diagonal, count(DISTINCT j) AS n, list(DISTINCT j) AS js
  FROM g JOIN t USING (gram) GROUP BY ALL),
r AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM v WHERE NOT exact)),
m AS (
  SELECT doc_id, label, len(list_distinct(flatten(list(js)))) / CAST(max(pairs) AS DOUBLE) AS coverage FROM r GROUP BY doc_id, template, label, run),
spans AS (
  SELECT doc_id, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM v WHERE exact AND n = pairs
  UNION ALL SELECT doc_id, label, false, NULL, coverage FROM m WHERE coverage >= {COVER}),
f AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) AS first_word, max(start) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
  FROM spans GROUP BY doc_id)"""
