import random

import corpus_pipeline
import pytest
from awkward_tables import DOCS, awkward_rows, empty, prose, with_clashes

from tierlens.llm.common import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted copies, benchmark passages and junk beside clean documents."""
    rng = random.Random(11)
    clean = [(k, prose(rng, 150, 4000), "en", "abc"[k % 3], None) for k in range(120)]
    passage = prose(rng, 40, 4000)
    copies = [(1000 + k, clean[k][1], "en", "a", None) for k in range(30)] + [(1100 + k, clean[7][1], None, None, None) for k in range(40)]
    leaks = [(2000 + k, prose(rng, 60, 4000) + " " + passage + " " + prose(rng, 60, 4000), "en", "b", None) for k in range(10)]
    junk = [(3000 + k, " ".join(w.upper() + "!!" for w in prose(rng, 100, 4000).split(" ")), "en", "c", None) for k in range(60)]
    path = tmp_path_factory.mktemp("tables")
    rows = clean + copies + leaks + junk
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 3000), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, folder):
    out = staged(spark, folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(out[n].columns == COLUMNS for n in names[:-1])
    good = ids(out["quality_classifier"])
    assert sum(i >= 3000 for i in good) <= 2 and sum(i < 120 for i in good) >= 118
    single = ids(out["simhash_near_dedup"])
    assert len(single) == len(set(single)) and not [i for i in single if 1000 <= i < 1200]
    assert set(i for i in good if i < 120) <= set(single)
    assert ids(out["benchmark_decontamination"]) == [i for i in single if not 2000 <= i < 3000]
    mixed = ids(out["source_mixing"])
    assert set(mixed) <= set(ids(out["benchmark_decontamination"])) and max(map(mixed.count, set(mixed))) <= 3
    last = out["sharding"]
    assert last.columns == [*COLUMNS, "size", "shard", "slot"] and ids(last) == mixed
    for shard in range(24):
        slots = sorted(r["slot"] for r in last.where(f"shard = {shard}").collect())
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*COLUMNS, "size", "shard", "slot"] and got.count() > 0


def test_stages_take_awkward_and_empty_tables(spark, folder):
    rows = [r for r in awkward_rows() if r[0] != 5]
    for docs in (with_clashes(spark.createDataFrame(rows, DOCS), "fp", "found", "score", "row", "place"), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, folder)
            assert set(docs.columns) <= set(got.columns) and got.count() <= 3 * len(rows)
