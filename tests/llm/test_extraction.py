import html
import itertools
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from tierlens.llm import crf, extraction
from tierlens.llm.html_blocks import blocks
from tierlens.llm.page_samples import labelled_pages

PAGES = "page_id long, url string, html string"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TIERLENS_SF", "/root/testdata/sf0.01")


def random_chain(seed):
    rng = np.random.default_rng(seed)
    return crf.Chain(rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))


def total(chain, scores, labels):
    out = chain.first[labels[0]] + chain.last[labels[-1]] + sum(s for s, y in zip(scores, labels) if y)
    return out + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_finds_the_best_of_all_labellings(seed):
    chain = random_chain(seed)
    scores = np.random.default_rng(100 + seed).normal(size=1 + seed % 8).tolist()
    best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda y: total(chain, scores, y))
    assert chain.viterbi(scores) == list(best)
    assert chain.viterbi([]) == []


def test_likelihood_and_gradient_are_those_of_all_labellings():
    chain = random_chain(1)
    rng = np.random.default_rng(2)
    scores, labels, sizes = rng.normal(size=(4, 5)), rng.integers(0, 2, (4, 5)), np.array([5, 4, 3, 1])
    labels[np.arange(5)[None, :] >= sizes[:, None]] = 0

    def brute():
        out = 0.0
        for s, y, n in zip(scores, labels, sizes):
            every = [total(chain, s[:n], z) for z in itertools.product((0, 1), repeat=int(n))]
            out += total(chain, s[:n], y[:n]) - np.logaddexp.reduce(every)
        return out

    value, by_score, by_moves, by_first, by_last = crf.likelihood(chain, scores, labels, sizes)
    assert value == pytest.approx(brute())
    for array, slope in ((scores, by_score), (chain.moves, by_moves), (chain.first, by_first), (chain.last, by_last)):
        for at in np.ndindex(array.shape):
            kept = array[at]
            array[at] = kept + 1e-5
            up = brute()
            array[at] = kept - 1e-5
            down = brute()
            array[at] = kept
            assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_pages_made_by_rule():
    chain = extraction.default_chain()
    right = size = 0
    for page in labelled_pages(150, seed=1234):
        found = blocks(page)
        kept = extraction.main_blocks(chain, page)
        wrong = [b for b in found if b.main != (b.text in kept)]
        size += len(found)
        right += len(found) - len(wrong)
    assert right / size > 0.96


def test_pages_of_the_table_against_their_article_element(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in extraction.main_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", row["html"] or "", re.S)[1]
        bare = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)>", " ", body))
        assert row["text"] == " ".join(html.unescape(bare).split())
        assert row["n_chars"] == len(row["text"])


CASES = {
    "all kinds of boilerplate": (
        '<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>'
        '<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>'
        '<article><h1>A title here</h1><p>First <b>bold</b>ly said, and <a href="/x">linked</a>.</p><div class="ad">Buy this now.</div>'
        "<ul><li>Item one of the text, said at length.</li><li>Item two of the text, said at length.</li></ul><p>Last&nbsp;words &lt;here&gt; &#233;&#x4e2d;.</p></article>"
        '<section id="comments"><div class="comment"><p>I do not agree with this at all.</p></div><form><label>Name</label><textarea>Say it</textarea></form></section>'
        '<aside class="sidebar"><h3>Related</h3><a href="/r">Other story</a></aside><footer>&copy; 2020 Us</footer></body></html>',
        "A title here First boldly said, and linked. Item one of the text, said at length. Item two of the text, said at length. Last words <here> é中.",
    ),
    "short article": ("<body><nav><a href=/a>A</a></nav><article><p>Be.</article><footer>&copy; x</footer>", "Be."),
    "unclosed and upper case": ("<BODY><ARTICLE><P>One<P><B>Two<BR>three<P>four</ARTICLE><FOOTER>end", "One Two three four"),
    "comments of the markup": ("<article><h1>Title</h1><!-- <p>no</p> --><p>yes it is<!--> and more --></p><p>Some more.</p><!-- open <p>gone", "Title yes it is and more --> Some more."),
    "signs that are text": ("<article><p>1 < 2 & 3 > 2, a <\nb, &notanentity; &amp;amp;</p></article>", "1 < 2 & 3 > 2, a < b, ¬anentity; &amp;"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert " ".join(extraction.main_blocks(extraction.default_chain(), page)) == want


@pytest.mark.parametrize("page, want", [
    ("<article><p>x</p></article>", "x"), ("<article>x</article>", "x"), ("<article><p>Two words</p></article>", "Two words"), ("<body><article><p>Be</article></body>", "Be"),
    ("<nav><a href=/>x</a></nav>", ""), ("<footer>x</footer>", ""),
])
def test_pages_of_one_short_part(page, want):
    assert " ".join(extraction.main_blocks(extraction.default_chain(), page)) == want


def test_the_fitted_chain_is_the_same_for_every_hash_seed():
    code = (
        "import hashlib; from tierlens.llm import extraction; from tierlens.llm.page_samples import labelled_pages; "
        "print(hashlib.md5(extraction.fit(labelled_pages(40)).weights.tobytes()).hexdigest())"
    )
    made = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": seed}, cwd=REPO, capture_output=True, text=True, check=True).stdout for seed in "123"}
    assert len(made) == 1


def test_awkward_rows(spark):
    rng = random.Random(3)
    long_text = " ".join(f"w{rng.randrange(999)}" for _ in range(150_000))
    deep = "<div class='a'>" * 20_000 + "deep"
    rows = [
        (1, "u", None), (2, None, ""), (None, None, "no markup at all, just a line of text"), (4, "u", " \n "), (5, "u", "<article><p>x</p></article>"), (5, "u", "<article><p>x</p></article>"),
        (6, "u", f"<nav><a href=/>m</a></nav><article><p>{long_text}</p></article>"), (7, "u", deep), (8, "u", "<"), (9, "u", "<p"), (10, "u", "&#xD800;&#0;\u0000"),
        (11, "u", '<a href="' * 3_000),
    ]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'mine' as text", "'mine' as `N_chars`", "'kept' as `a.b`")
    out = extraction.main_text(pages)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and sorted(out.columns) == sorted(["page_id", "url", "html", "a.b", "text", "n_chars"])
    assert all(got[k]["text"] == "" and got[k]["n_chars"] == 0 for k in (1, 2, 4, 8, 9, 11))
    assert got[5]["text"] == "x" and got[6]["text"] == long_text and got[6]["n_chars"] == len(long_text) and got[5]["a.b"] == "kept"
    assert extraction.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_a_chain_of_ones_own_labelled_pages(spark):
    rng = random.Random(1)
    part = lambda: rng.choice(('<pre data-main="1">some words</pre>', "<li>some words</li>"))
    own = ["".join(part() for _ in range(1 + k % 5)) for k in range(200)]
    pages = spark.createDataFrame([(1, "<pre>kept</pre><li>gone</li><pre>kept too</pre>")], "page_id long, html string")
    assert extraction.main_text(pages, chain=extraction.fit(own)).first()["text"] == "kept kept too"
