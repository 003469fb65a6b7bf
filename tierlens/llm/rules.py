"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.llm.common import WORD, free_name, quoted, space_words, without, written

#: Signs of markup and tables.
SYMBOLS = r"[#*$%&|<>]"
#: Signs that plain prose hardly has.
MARKS = r"[!#$%&*+/<=>@\\^_`{|}~\[\]]"
ROUNDS = 12
KEEP_AT = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_MORE = ("n_lines", "n_marks", "n_upper")

#: Each rule as (name, bad if, good if) over the counts; otherwise it abstains.  Whole-number comparisons, so that SQL can say the same.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words < 50", "n_words >= 80"),
    ("symbols", "100 * n_symbols > 25 * n_words", "100 * n_symbols <= 3 * n_words"),
    ("marks", "100 * n_marks > 25 * n_words", "100 * n_marks <= 5 * n_words"),
    ("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper <= 12 * word_chars"),
    ("repeats", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("lines", "100 * n_dup_lines > 40 * n_lines", "n_dup_lines = 0"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
)


def _repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that occur twice or more in the row's array `words`.

    Windows are 64-bit hashes.  Where some occur twice, each is packed into one
    long, low bits of its hash above its place, so that a sort of plain longs
    brings equal windows together.
    """
    grams, many, bits, packed, starts = (free_name(docs, n) for n in ("grams", "has_twice", "place_bits", "packed_grams", "repeat_starts"))
    w, g = F.col(words), F.col(grams)
    step = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))
    one = docs.withColumn(grams, step)
    two = one.select("*", (F.size(F.array_distinct(g)) < F.size(g)).alias(many), F.ceil(F.log2(F.size(g) + 1.0)).cast("int").alias(bits))
    shift = lambda name, x, n: F.call_function(name, x, n)
    in_order = F.sort_array(F.transform(g, lambda h, i: shift("shiftleft", h, F.col(bits)).bitwiseOR(i.cast("long"))))
    three = two.withColumn(packed, F.when(F.col(many), in_order))
    p, mask = F.col(packed), shift("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    place = lambda k: F.get(p, k).bitwiseAND(mask).cast("int")
    alike = lambda a, b: F.get(g, place(a)) == F.get(g, place(b))
    last = F.size(p) - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & alike(k, k - 1)) | ((k < last) & alike(k, k + 1)))
    four = three.withColumn(starts, F.when(p.isNotNull(), F.sort_array(F.transform(twice, lambda k: place(k).cast("long")))))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        F.col(starts), F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, s: F.struct((acc["n"] + s + 3 - F.greatest(s, acc["end"])).alias("n"), (s + 3).alias("end")), lambda acc: acc["n"],
    )
    return four.withColumn(out, F.coalesce(covered, zero)).drop(grams, many, bits, packed, starts)


def with_counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of BASE and those that the rules also read; `keep` names the columns to carry along.

    A null or empty text has no words and fails the base.
    """
    source = without(docs, *BASE, *_MORE)
    kept = [c for c in source.columns if keep is None or c in keep]
    body, words, filled = (free_name(source, n) for n in ("_whole_text", "_words", "_filled_lines"))
    text = F.col(body)
    split = source.select(*[F.col(quoted(c)) for c in kept], F.coalesce("text", F.lit("")).alias(body)).withColumn(words, space_words(text))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    counted = split.select(
        *[F.col(quoted(c)) for c in kept], words, F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        count(MARKS).alias("n_marks"), count("[A-Z]").alias("n_upper"), lines.alias(filled),
    ).withColumns({
        "n_lines": F.size(filled).cast("long"), "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
    }).drop(filled)
    full = _repeat_words(counted, words, "n_repeat_words").drop(words)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return full.withColumn("base_failed", failed)


def vote(bad: str, good: str) -> Column:
    """-1 against the document, 1 for it, 0 abstains (also where there are no words)."""
    return F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


VOTES = [f"vote_{name}" for name, _, _ in RULES]


def with_votes(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[vote(bad, good).alias(v) for v, (_, bad, good) in zip(VOTES, RULES)])


def _posterior(prior: float, tables: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """Probability of a good document given its votes; tables[v][vote] = (share among good, share among bad)."""
    odds = F.lit(log(prior / (1 - prior)))
    for v, shares in tables.items():
        pick = F.lit(0.0)
        for value, (good, bad) in shares.items():
            pick = F.when(F.col(v) == value, F.lit(log(good / bad))).otherwise(pick)
        odds = odds + pick
    return 1 / (1 + F.exp(-odds))


def fit_posterior(votes: DataFrame, rounds: int = ROUNDS) -> Column:
    """The posterior of a good document as a column over VOTES, from all rows' votes.

    Rows with equal votes are one pattern (3 to the number of rules at most).
    The first guess calls a pattern good if no rule votes against it; each
    round is one aggregation over the patterns, whose sums give the prior and
    each rule's distribution of votes on good and on bad documents (with one
    added to each count).
    """
    patterns = written(votes.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    against = F.lit(False)
    for v in VOTES:
        against = against | (F.col(v) == -1)
    good = F.when(against, 0.1).otherwise(0.9)
    for _ in range(rounds):
        weighed = patterns.select(*VOTES, "n", (F.col("n") * good).alias("g"))
        sums = weighed.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"),
            *[F.coalesce(F.sum(F.when(F.col(v) == x, F.col(c))), F.lit(0)).cast("double").alias(f"{v}:{x}:{c}") for v in VOTES for x in (-1, 0, 1) for c in ("n", "g")],
        ).first()
        n, g = float(sums["n"]), float(sums["g"])
        tables = {
            v: {x: ((sums[f"{v}:{x}:g"] + 1) / (g + 3), (sums[f"{v}:{x}:n"] - sums[f"{v}:{x}:g"] + 1) / (n - g + 3)) for x in (-1, 0, 1)} for v in VOTES
        }
        good = _posterior((g + 1) / (n + 2), tables)
    return good


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of BASE, the posterior probability of quality and `kept` to each row.

    kept is false where the base fails, else whether the posterior reaches
    KEEP_AT.  Repeated rows count as often as they occur; an empty table gives
    an empty one.  Columns with the names added are replaced.
    """
    source = without(docs, "posterior", "kept", *VOTES)
    counts = written(with_counts(source, keep), "rule-counts")
    votes = with_votes(counts)
    return votes.withColumn("posterior", fit_posterior(votes)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).drop(*VOTES, *_MORE)


def em_sql(counts: str) -> str:
    """The same verdicts as SQL over a table `counts` (for the oracle): one pair of tables for each round."""
    cases = ", ".join(
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {v}" for v, (_, bad, good) in zip(VOTES, RULES)
    )
    names = ", ".join(VOTES)
    against = " OR ".join(f"{v} = -1" for v in VOTES)
    parts = [
        f"votes AS MATERIALIZED (SELECT *, {cases} FROM {counts})",
        f"patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM votes GROUP BY {names})",
        f"e0 AS MATERIALIZED (SELECT *, n * CASE WHEN {against} THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS g FROM patterns)",
    ]
    for k in range(ROUNDS):
        sums = ", ".join(
            f"(coalesce(sum(CASE WHEN {v} = {x} THEN g END), 0) + 1) / (sum(g) + 3) AS g_{v}_{x + 1}, "
            f"(coalesce(sum(CASE WHEN {v} = {x} THEN n - g END), 0) + 1) / (sum(n) - sum(g) + 3) AS b_{v}_{x + 1}"
            for v in VOTES for x in (-1, 0, 1)
        )
        parts.append(f"m{k} AS MATERIALIZED (SELECT (sum(g) + 1) / (sum(n) + 2) AS prior, {sums} FROM e{k})")
        odds = " + ".join(
            ["ln(prior / (1 - prior))"] + [f"CASE {v} " + " ".join(f"WHEN {x} THEN ln(g_{v}_{x + 1} / b_{v}_{x + 1})" for x in (-1, 0, 1)) + " END" for v in VOTES]
        )
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT {names}, n, n / (1 + exp(-({odds}))) AS g FROM patterns, m{k})")
    parts.append(f"verdicts AS (SELECT votes.*, e.g / e.n AS posterior FROM votes JOIN e{ROUNDS} e USING ({names}))")
    return ",\n".join(parts)
