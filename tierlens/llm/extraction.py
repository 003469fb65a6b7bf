"""Main text of web pages: a chain over the leaf blocks of a page, trained on labelled pages, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierlens.llm import crf
from tierlens.llm.common import quoted, without
from tierlens.llm.html_blocks import FEATURES, blocks
from tierlens.llm.page_samples import labelled_pages

#: Labelled pages that the chain is fitted on, at most.
LABELLED_PAGES = 1_000


def fit(pages: Iterable[str]) -> crf.Chain:
    """A chain from labelled pages, in which an attribute marks the elements that are main text (html_blocks.LABEL)."""
    items, labels = [], []
    for html in pages:
        found = blocks(html)
        items.append([[*sorted(b.place), *b.own] for b in found])    # in one order, so that sums agree between runs
        labels.append([int(b.main) for b in found])
    return crf.fit(items, labels, FEATURES)


@lru_cache(maxsize=1)
def default_chain() -> crf.Chain:
    return fit(labelled_pages(LABELLED_PAGES))


def main_blocks(chain: crf.Chain, html: str, weights: list[float] | None = None) -> list[str]:
    """The texts of a page's main blocks, in page order."""
    found = blocks(html)
    weights = chain.weights.tolist() if weights is None else weights
    around: dict[frozenset, float] = {}
    scores = []
    for block in found:
        score = around.get(block.place)
        if score is None:
            score = around[block.place] = sum(weights[f] for f in sorted(block.place))
        scores.append(score + sum(weights[f] for f in block.own))
    return [block.text for block, label in zip(found, chain.viterbi(scores)) if label]


def main_text(pages: DataFrame, column: str = "html", chain: crf.Chain | None = None) -> DataFrame:
    """`pages` with `text`, the main text of the whole page in `column`, and `n_chars`, its code points.

    Texts of the main blocks are joined by one space in page order, nothing is
    cut; white space inside a block is one space; character references are
    decoded.  A null or empty page, and one without main blocks, has an empty
    text.  Repeated rows give repeated rows, an empty table none; columns
    named text or n_chars are replaced, all others stay.  Pages are
    independent, so no row moves.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        weights = shared.value.weights.tolist()
        return pd.Series([" ".join(main_blocks(shared.value, page or "", weights)) for page in html], dtype=object)

    text = extract(F.coalesce(F.col(quoted(column)), F.lit("")))
    found = pages.withColumn("_main_text_", text)
    out = without(found, "text", "n_chars").withColumnRenamed("_main_text_", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
