"""Notation alphabet, count code and row grammar as column expressions.

A notation row is a sequence of runs (symbol, count).  It is written on three
aligned tiers: symbols that go up, encoded counts, symbols that go down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tierlens.functions.bind import let

# Fixed values (must equal the notation's own tables).
UP_SYMBOLS = "ABCDEFGHIJKLMNPQ"
DOWN_SYMBOLS = "RSTUVWXYZ[\\]^_"
AMBIGUOUS_SYMBOLS = "O"
UNIT_GLYPHS = "abcdefghi"                   # 1..9
TEN_GLYPHS = "jklmnopqrstuvwxyz{|'()*+,"    # 10, 20 .. 250
VOCABULARY = " '()*+,ABCDEFGHIJKLMNPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz{|"
MIN_COUNT, MAX_COUNT = 1, 259
ROLES = ("upper", "count", "lower")

COUNT_GLYPHS = UNIT_GLYPHS + TEN_GLYPHS
TRUSTED_SYMBOLS = UP_SYMBOLS + DOWN_SYMBOLS


def _place(char: Column, alphabet: str) -> Column:
    """1-based place of a one-character column in a literal alphabet, 0 if absent."""
    return F.when(char == "", 0).otherwise(F.position(char, F.lit(alphabet)))


def strip_to(text: Column, alphabet: str) -> Column:
    """What is left of `text` after all characters of `alphabet` are dropped."""
    return F.translate(text, alphabet, "")


def token_kind(char: Column) -> Column:
    """Class of one character: up, down, count, space, newline or other."""
    return (
        F.when(_place(char, UP_SYMBOLS) > 0, "up")
        .when(_place(char, DOWN_SYMBOLS) > 0, "down")
        .when(_place(char, COUNT_GLYPHS) > 0, "count")
        .when(char == " ", "space")
        .when(char == "\n", "newline")
        .otherwise("other")
    )


def encode_count(n: Column) -> Column:
    """Glyphs of a count in 1..259; null outside the range."""
    n = n.cast("int")
    tens, units = F.floor(n / 10).cast("int"), n % 10
    glyphs = F.concat(
        F.when(tens > 0, F.substr(F.lit(TEN_GLYPHS), tens, F.lit(1))).otherwise(""),
        F.when(units > 0, F.substr(F.lit(UNIT_GLYPHS), units, F.lit(1))).otherwise(""),
    )
    return F.when(n.between(MIN_COUNT, MAX_COUNT), glyphs)


def decode_count(glyphs: Column) -> Column:
    """Count of one encoded token; null when it is not a canonical token."""
    first, second = F.substr(glyphs, F.lit(1), F.lit(1)), F.substr(glyphs, F.lit(2), F.lit(1))
    place = lambda char, alphabet: F.position(char, F.lit(alphabet))  # noqa: E731  (never of an empty text here)
    unit, ten = place(glyphs, UNIT_GLYPHS), place(glyphs, TEN_GLYPHS)
    return F.when(F.length(glyphs) == 1, F.when(unit > 0, unit).when(ten > 0, 10 * ten)).when(
        (F.length(glyphs) == 2) & F.contains(F.lit(TEN_GLYPHS), first) & F.contains(F.lit(UNIT_GLYPHS), second),
        10 * place(first, TEN_GLYPHS) + place(second, UNIT_GLYPHS),
    )


def count_boundaries() -> list[int]:
    """Counts at which the code changes shape: units, decade edges, maximum."""
    edges = {n for ten in range(10, MAX_COUNT + 1, 10) for n in (ten - 1, ten)}
    return sorted(edges | set(range(1, 10)) | {MAX_COUNT})


def symbol_direction(symbol: Column) -> Column:
    """UP or DOWN for a trusted symbol, null for ambiguous or foreign ones."""
    one = F.length(symbol) == 1
    return F.when(one & (_place(symbol, UP_SYMBOLS) > 0), "UP").when(
        one & (_place(symbol, DOWN_SYMBOLS) > 0), "DOWN"
    )


def symbol_at(index: Column) -> Column:
    """Trusted symbol number `index` (0-based), up symbols first."""
    return F.substr(F.lit(TRUSTED_SYMBOLS), index.cast("int") + 1, F.lit(1))


def canonical_rows(runs: DataFrame, by: list[str], order: list[str], *marks: Column) -> DataFrame:
    """Three canonical tiers per row of a run table with columns symbol, count, and further aggregates `marks` of its runs.

    The ordered runs of one notation row are gathered once; a row is a single
    drawn line, so its run list is as long as the text it becomes.
    """
    known = (F.length("symbol") == 1) & F.contains(F.lit(TRUSTED_SYMBOLS), F.col("symbol"))
    coded = runs.withColumn("_code", encode_count(F.col("count")))
    coded = coded.withColumn("_drawn", F.rpad(F.when(known, F.col("symbol")).otherwise(" "), F.length("_code"), F.lit(" ")))
    key = F.struct(*order, F.col("symbol").alias("symbol"), F.col("count").alias("count"), F.col("_code").alias("code"), F.col("_drawn").alias("drawn"))
    gathered = coded.groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("_runs"), *marks)
    # all symbols stand on one line first; a tier blanks out those of the other direction
    line, blank = F.array_join("_runs.drawn", ""), lambda symbols: " " * len(symbols)
    return gathered.select(
        *by, F.transform("_runs", lambda r: F.struct(r["symbol"].alias("symbol"), r["count"].alias("count"))).alias("runs"), *[c for c in gathered.columns if c not in (*by, "_runs")],
        F.rtrim(F.translate(line, DOWN_SYMBOLS, blank(DOWN_SYMBOLS))).alias("upper"), F.rtrim(F.array_join("_runs.code", "")).alias("count"),
        F.rtrim(F.translate(line, UP_SYMBOLS, blank(UP_SYMBOLS))).alias("lower"),
    )


def _json_text(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def row_json(runs: Column) -> Column:
    """Compact JSON [[symbol, count, direction], ...] of ordered runs."""
    item = lambda r: F.concat(
        F.lit("["), _json_text(r["symbol"]), F.lit(","), r["count"].cast("string"),
        F.lit(',"'), symbol_direction(r["symbol"]), F.lit('"]'),
    )
    return F.concat(F.lit("["), F.array_join(F.transform(runs, item), ","), F.lit("]"))


def semantic_key(rows: DataFrame, by: list[str], row_order: str) -> DataFrame:
    """SHA-256 of the nested (symbol, count, direction) rows of each sample."""
    packed = rows.select(*by, F.struct(F.col(row_order).alias("o"), row_json(F.col("runs")).alias("j")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), ",")
    return packed.groupBy(*by).agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("semantic_key"))


# -- structural checks of decoded text ---------------------------------------

def tier_lines(text: Column) -> Column:
    """Three tiers of a decoded text: missing lines empty, extra lines joined below."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.struct(
        F.get(lines, F.lit(0)).alias("upper"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("count"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), "").alias("lower"),
        F.size(lines).alias("line_count"),
    )


def tier_alphabet(role: str) -> str:
    return {"upper": UP_SYMBOLS, "count": COUNT_GLYPHS, "lower": DOWN_SYMBOLS}[role]


def illegal_characters(text: Column, role: str) -> Column:
    """Sorted distinct characters that may not stand on this tier (space is legal)."""
    residue = strip_to(text, " " + tier_alphabet(role))
    return F.array_join(F.array_sort(F.array_distinct(F.split(residue, ""))), "")


def check_tiers(text: Column) -> Column:
    """Struct of repaired tiers, issue names and a validity flag."""

    def check(t: Column) -> Column:
        residue = {r: strip_to(t[r], " " + tier_alphabet(r)) for r in ROLES}
        issues = F.array_compact(
            F.array(
                F.when(t["line_count"] != 3, F.concat(F.lit("line_count:"), t["line_count"].cast("string"))),
                *[F.when(residue[r] != "", F.concat(F.lit(f"{r}:"), illegal_characters(residue[r], r))) for r in ROLES],
                F.when(F.regexp_replace(t["count"], r"\s+", "") == "", "count_empty"),
            )
        )
        return F.struct(*[t[r].alias(r) for r in ROLES], issues.alias("issues"), (F.size(issues) == 0).alias("valid"))

    return let(tier_lines(text), check)


def parse_runs(text: Column) -> Column:
    """Runs `<symbol><1-2 count glyphs>` of a run text, with issue names.

    Characters outside the alphabet are reported and skipped, as are count
    glyphs before the first symbol; a symbol keeps however many glyphs follow.
    """
    symbols = "".join("\\" + c if c in "[\\]^" else c for c in TRUSTED_SYMBOLS)
    counts = "".join("\\" + c if c in "()*+{|" else c for c in COUNT_GLYPHS)
    parts = lambda known: F.regexp_extract_all(known, F.lit(f"([{symbols}][{counts}]*)"), F.lit(1))
    split = lambda p: F.struct(
        F.substr(p, F.lit(1), F.lit(1)).alias("symbol"), F.substr(p, F.lit(2)).alias("encoded_count"),
        symbol_direction(F.substr(p, F.lit(1), F.lit(1))).alias("direction"),
    )

    def check(known: Column) -> Column:
        early = F.length(F.regexp_extract(known, f"^([{counts}]*)", 1))
        foreign = F.length(text) - F.length(known)
        bad = lambda runs: F.size(F.filter(runs, lambda r: ~F.length(r["encoded_count"]).between(1, 2)))
        return let(
            F.transform(parts(known), split),
            lambda runs: F.struct(
                runs.alias("runs"), bad(runs).alias("bad_runs"), early.alias("early_counts"), foreign.alias("foreign_chars"),
                ((bad(runs) == 0) & (early == 0) & (foreign == 0) & (F.size(runs) > 0)).alias("valid"),
            ),
        )

    return let(F.regexp_replace(text, f"[^{symbols}{counts}]", ""), check)
