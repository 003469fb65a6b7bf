import hashlib
import re

from awkward_tables import awkward, awkward_rows, empty, with_clashes

from tierlens.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            width = min(window, len(v))
            for k in range(len(v) - width + 1) if v else ():
                for p in range(len(w) - width + 1):
                    if w[p : p + width] == v[k : k + width]:
                        hit.update(range(p, p + width))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    docs = awkward_rows()
    long_text = next(r[1] for r in docs if r[0] == 5).split(" ")
    passage = " ".join(long_text[500:540])
    docs = [r if r[0] != 5 else (5, " ".join(long_text[:2000]), *r[2:]) for r in docs]
    docs += [(200, f"Before, {passage.upper()}! after", None, None, None), (201, " ".join(long_text[500:509]), None, None, None), (202, "b b b b b b b b b b b b b", None, None, None)]
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "Plain TEXT"), (None, "中文"), (10, "b " * 15), (11, "..."), (12, " ".join(long_text[530:560]))]
    return docs, items


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, ITEMS)
    assert rows(decontaminate.contamination(spark, d, b)) == brute(docs, items)


def test_many_blocks_are_as_one(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert rows(decontaminate.contamination(spark, d, b)) == brute(docs, items)


def test_longest_match_and_spans(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").where("doc_id = 200")
    found = decontaminate.with_matches(spark, d, spark.createDataFrame(items[:1], ITEMS)).first()["found"]
    assert found["longest"] == 40 and [tuple(s) for s in found["spans"]] == [(1, 40)]


def test_removes_documents_and_keeps_columns(spark):
    docs, items = cases()
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "found", "_whole_text", "item_id")
    kept = decontaminate.decontaminate(spark, d, spark.createDataFrame(items, ITEMS))
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(spark, empty(spark), none).count() == 0
    assert decontaminate.decontaminate(spark, awkward(spark), none).count() == len(awkward_rows())
