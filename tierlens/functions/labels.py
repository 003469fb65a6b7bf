"""Scalar label, geometry and path functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

MODEL_HEIGHT = 64          # fixed value: line images are scaled to this height
MODEL_STRIDE = 4           # fixed value: two halvings of the width


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_newline_end(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]+$", "")


def clean_label(raw: Column) -> Column:
    """Training target: leading spaces carry the offset and go, all others stay."""
    return F.regexp_replace(raw, "^ +", "")


def leading_offset(raw: Column) -> Column:
    return F.length(raw) - F.length(clean_label(raw))


def resized_width(width: Column, height: Column) -> Column:
    """Width after scaling to the model height, ties to even, at least one pixel."""
    return F.greatest(F.lit(1), F.rint(width * (F.lit(float(MODEL_HEIGHT)) / height)).cast("int"))


def ctc_steps(width: Column, stride: int = MODEL_STRIDE, rounding: str = "floor", offset: int = 0) -> Column:
    """Output frames of an image `width` pixels wide."""
    if rounding not in ("floor", "ceil") or stride < 1:
        raise ValueError("rounding is floor or ceil and stride is positive")
    cut = F.floor if rounding == "floor" else F.ceil
    return F.greatest(F.lit(1), (cut(width / stride) + offset).cast("int"))


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def ctc_required(text: Column) -> Column:
    """Frames needed to emit `text`: its length plus one per equal neighbour pair.

    A run of r equal characters has r-1 such pairs, so the pairs are what
    collapsing the runs removes.
    """
    return 2 * F.length(text) - F.length(collapse_repeats(text))


def ctc_required_ids(ids: Column) -> Column:
    repeats = F.filter(ids, lambda x, i: (i > 0) & (F.get(ids, i - 1) == x))
    return F.size(ids) + F.size(repeats)


def unknown_characters(text: Column, vocabulary: str) -> Column:
    """Sorted distinct characters outside the vocabulary, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.translate(text, vocabulary, ""), ""))), "")


def row_text(upper: Column, count: Column, lower: Column) -> Column:
    """Target of a whole row in `tiers` mode."""
    return F.concat_ws("\n", upper, count, lower)


def runs_text(runs: Column) -> Column:
    """Target of a whole row in `runs` mode."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["symbol"], r["encoded_count"])), "")


def valid_path(path: Column, split: Column | str, folder: str) -> Column:
    """True for `<split>/<folder>/...` in plain relative form."""
    split = F.lit(split) if isinstance(split, str) else split
    prefix = F.concat(split, F.lit(f"/{folder}/"))
    plain = ~path.rlike(r"[\\:]|//|/$|^/|(^|/)\.{1,2}(/|$)")
    return F.coalesce(plain & F.startswith(path, prefix) & (F.length(path) > F.length(prefix)), F.lit(False))


def ratio(numerator: Column, denominator: Column, empty: str = "null") -> Column:
    """Quotient as double; no denominator gives null, or 0.0 with empty='zero'."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(value, F.lit(0.0)) if empty == "zero" else value


def length_group(length: Column) -> Column:
    """Fixed length classes of the evaluation reports."""
    return F.when(length <= 4, "short_le4").when(length < 65, "medium_5_to64").otherwise("long_ge65")


def row_group(rows: Column) -> Column:
    return F.when(rows == 1, "single_row").otherwise("multi_row")


def fidelity_key(text: Column, ink_only: bool = False, aliases: bool = False) -> Column:
    """Text for fidelity comparison: edge spaces (or all spaces) dropped, look-alikes merged."""
    out = F.replace(text, F.lit(" "), F.lit("")) if ink_only else F.trim(text)
    return F.translate(out, "X", "B") if aliases else out


def without_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def cohort(splits: Column, declared: Column, verified: Column) -> Column:
    """Evaluation cohort of a parent from the splits it was seen in (the names are fixed values)."""
    seen = F.array_contains(splits, "train") | F.array_contains(splits, "validation")
    only_test = (F.size(splits) == 1) & F.array_contains(splits, "test")
    return (
        F.when(seen, "excluded_seen_or_validation")
        .when(declared == "test", "positive_frozen_test")
        .when(declared.isNotNull(), F.concat(F.lit("excluded_stage2a_"), declared))
        .when(only_test & verified, "general_stage1_test")
        .when(only_test, "general_test_structure_match_exploratory")
        .otherwise("general_unassigned_exploratory")
    )


def named_issues(checks: Iterable[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds; null counts as not holding."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
