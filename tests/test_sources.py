"""Files in and out, journals and streams."""

import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from tierlens.functions.hashing import record_hash
from tierlens.sources import journal as J, manifest as M, samples as S
from tierlens.streaming import journal as ST, state as ST_STATE


def test_csv_round_trip_keeps_every_space(spark, tmp_path):
    rows = [("train", "b", '  x, "y" '), ("train", "a", ""), ("test", "c", None), ("test", "d", "back\\slash\nline ")]
    df = spark.createDataFrame(rows, "split string, tier_id string, raw_label string")
    M.write_subset(df, f"{tmp_path}/t", files=2)
    back = M.read_manifest(spark, f"{tmp_path}/t", df.schema)
    assert M.readback_differences(df, back).count() == 0
    assert M.file_order_violations(back, ["split", "tier_id"]).count() == 0
    with pytest.raises(PySparkException):
        M.write_subset(df, f"{tmp_path}/t")


def test_the_subset_check_writes_each_text_once(spark, monkeypatch):
    """paths and clean labels were written beside what they derive from, hashes were shuffled as 64 characters."""
    from tierlens.plans import label_queries

    written, own = [], label_queries.materialize
    monkeypatch.setattr(label_queries, "materialize", lambda df, name: written.append(df.columns) or own(df, name))
    got = label_queries.s08(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["differences"] == 0 and r["out_of_order"] == 0 for r in got)
    assert len(written) == 1 and not {"training_label", "image_path", "label_path"} & set(written[0])
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (1, "a"), (2, None)], [(1, "a"), (3, "c")]))
    lost = M.readback_differences(a, b, ["k"])
    assert {(r["k"], r["difference"]) for r in lost.collect()} == {(1, 1), (2, 1), (3, -1)}
    assert {r["record"] for r in lost.collect()} == {r["h"] for r in a.unionByName(b).select(record_hash(a).alias("h")).collect()}
    assert "unhex(" in lost._jdf.queryExecution().optimizedPlan().toString()


def test_byte_order_mark_is_skipped(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes('\ufeff"split","tier_id"\n"train"," a"\n'.encode())
    got = M.read_manifest(spark, str(path), T.StructType([T.StructField("split", T.StringType()), T.StructField("tier_id", T.StringType())]))
    assert [tuple(r) for r in got.collect()] == [("train", " a")]


def test_parquet_manifest_prunes_splits(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 1), ("test", "b", 2)], "split string, tier_id string, n int")
    M.write_manifest(df, f"{tmp_path}/p")
    plan = spark.read.parquet(f"{tmp_path}/p").where("split = 'test'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(100).withColumn("x", F.col("id") % 7)
    same = M.table_fingerprint(a.repartition(9)).first()
    assert same == M.table_fingerprint(a.orderBy(F.desc("id"))).first()
    assert same != M.table_fingerprint(a.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x")))).first()


def make_samples(root):
    for split, stem, image in (("train", "s1", "png"), ("test", "s2", None)):
        for folder in ("labels", "json", "images"):
            os.makedirs(root / split / folder, exist_ok=True)
        (root / split / "labels" / f"{stem}.txt").write_bytes(b"    N\r\njhjic\r\nY]R\r\n\r\n BGCJ NM\nafbajfajc\nX\n\n")
        note = {"sample_id": stem, "rows": 1, "cells_per_row": 3, "logical_rows": [{"row_index": 0, "upper": "    N ", "count_line": "jhjic", "lower": "Y]R", "runs": [{"symbol": "Y", "count": 10, "direction": "DOWN", "encoded_count": "j"}]}]}
        (root / split / "json" / f"{stem}.json").write_text(json.dumps(note))
        if image:
            (root / split / "images" / f"{stem}.{image}").write_bytes(b"x")


def test_sample_discovery_and_rows(spark, tmp_path):
    make_samples(tmp_path)
    found = {r["sample_id"]: r for r in S.discover_samples(spark, str(tmp_path)).collect()}
    assert (found["s1"]["split"], found["s1"]["image_path"]) == ("train", "train/images/s1.png")
    assert found["s2"]["image_path"] is None and found["s2"]["json_path"] == "test/json/s2.json"
    labels = S.read_labels(spark, f"{tmp_path}/*/labels").withColumn("sample_id", F.regexp_extract("path", r"([^/]+)\.txt$", 1))
    rows = S.parse_rows(labels, "sample_id", "raw_label").where("sample_id = 's1'").orderBy("row_index").collect()
    assert [(r["upper"], r["count"], r["lower"], r["error"]) for r in rows] == [("    N", "jhjic", "Y]R", None), (" BGCJ NM", "afbajfajc", "X", None)]
    notes = S.annotation_rows(S.read_annotations(spark, f"{tmp_path}/train/json"))
    agreement = S.label_agreement(S.parse_rows(labels, "sample_id", "raw_label").where("sample_id = 's1'"), notes, "sample_id").collect()
    assert [(r["row_index"], r["state"]) for r in agreement] == [(1, "only_in_text")]
    runs = S.annotation_runs(S.read_annotations(spark, f"{tmp_path}/train/json")).collect()
    assert [(r["symbol"], r["count"], r["encoded_count"]) for r in runs] == [("Y", 10, "j")]


def test_flat_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.png").write_bytes(b"x")
    got = S.discover_samples(spark, str(tmp_path)).collect()
    assert [(r["sample_id"], r["split"], r["label_path"], r["image_path"]) for r in got] == [("a", tmp_path.name, "a.txt", "a.png")]


def test_row_layout_errors_are_rows(spark):
    df = spark.createDataFrame([(1, " P\naj\n\n\n"), (2, "\naj\nW\n\n"), (3, "a\nb"), (4, "a\nb\nc\nd\n"), (5, "  \n"), (6, "A\na\nR")], "k int, t string")
    got = {}
    for r in S.parse_rows(df, "k", "t").collect():
        got[r["k"]] = (r["error"], r["upper"], r["count"], r["lower"])
    assert got == {1: (None, " P", "aj", ""), 2: (None, "", "aj", "W"), 3: ("line_count", None, None, None), 4: ("separator_not_empty", None, None, None), 6: (None, "A", "a", "R")}


def test_rows_of_a_text_are_parsed_once(spark):
    """the lines were split anew in every step and for every line of the text."""
    df = spark.createDataFrame([(1, None), (2, "A\r\na \t\r\n\r\n \t\r\n B\rj\rR"), (3, ""), (4, "\n\n\n\n")], "k int, t string")
    parsed = S.parse_rows(df, "k", "t")
    assert [tuple(r) for r in parsed.orderBy("k", "row_index").collect()] == [(2, None, 0, "A", "a", ""), (2, None, 1, " B", "j", "R")]
    kept = parsed.where("error is null")._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count("split(") == 1


def test_journal_tampering_is_found(spark):
    records = J.seal_records(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"), "id", ["v"], "plan")
    bad = records.withColumn("payload", F.when(F.col("id") == 2, F.lit('{"v":"z"}')).otherwise(F.col("payload")))
    expected = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    got = {(r["id"], r["issue"]) for r in J.journal_issues(bad.union(bad.where("id = 1")), expected, "id", "plan").collect()}
    assert got == {(2, "payload_drift"), (3, "unexpected"), (4, "missing"), (1, "duplicate_id")}
    assert {r["issue"] for r in J.journal_issues(records, records, "id", "other").collect()} == {"plan_drift"}


def test_segment_filters_are_made_in_slices():
    """the places of all ids of a segment were held at once, 200 bytes an id."""
    import tracemalloc

    import numpy as np

    hashes = np.random.default_rng(5).integers(-2**63, 2**63 - 1, 1_000_000)
    tracemalloc.start()
    try:
        packed = ST._filter_of(hashes)
        passed = ST._some_pass(hashes[-3:], packed), ST._some_pass(np.concatenate([np.arange(0), hashes[:1]]), packed)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    bits = np.zeros(16_000_000, bool)
    for k in range(0, 1_000_000, 250_000):
        bits[ST._places(hashes[k : k + 250_000], len(bits)).ravel()] = True
    assert packed == np.packbits(bits).tobytes() and passed == (True, True) and peak < 60e6
    assert not ST._some_pass(np.arange(3), bytes(8)) and not ST._some_pass(hashes[:0], packed)
    # a hit behind the first slice is found
    one = ST._filter_of(hashes[:1])
    many = np.full(ST.SLICE + 1, next(h for h in range(100) if not ST._some_pass(np.array([h]), one)))
    assert not ST._some_pass(many, one) and ST._some_pass(np.append(many, hashes[0]), one)


def test_stream_journal_resume_drift_and_seal(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id long, v string"

    def records():
        return J.seal_records(spark.readStream.schema(schema).json(source), "id", ["v"], "plan")

    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.json(source)
    ST.run_journal(records(), target, f"{tmp_path}/c1", "id", "plan")
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.mode("append").json(source)
    ST.run_journal(records(), target, f"{tmp_path}/c1", "id", "plan")
    ST.run_journal(records(), target, f"{tmp_path}/c2", "id", "plan")
    sealed_schema = records().schema
    table = ST.read_target(spark, target, sealed_schema)
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3]
    expected = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = ST.seal(spark, target, sealed_schema, expected, "id", "plan").first()
    assert done["rows"] == 3
    with pytest.raises(ValueError):
        ST.seal(spark, target, sealed_schema, expected.union(spark.createDataFrame([(9,)], "id long")), "id", "plan")
    spark.createDataFrame([(1, "changed")], schema).write.mode("append").json(source)
    with pytest.raises(Exception, match="drift"):
        ST.run_journal(records(), target, f"{tmp_path}/c1", "id", "plan")


def test_a_batch_reads_only_segments_that_its_ids_may_hit(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id string, v string"
    records = lambda: J.seal_records(spark.readStream.schema(schema).json(source), "id", ["v"], "plan")
    named = lambda low, high: spark.createDataFrame([(f"{hash_hex(k)}", "v") for k in range(low, high)], schema)
    read = []
    for k in range(4):
        named(k * 50, k * 50 + 50).coalesce(1).write.mode("append").json(source)
        ST.run_journal(records(), target, f"{tmp_path}/c{k % 2}", "id", "plan")
        read.append(sum(r["rows"] for r in ST.hit_segments(named(900, 940), target, "id", "other", 0).collect()))
    assert max(read) <= 8       # ids that the journal lacks: some rows of a wrongly passed filter at most, however long it is
    again = ST.hit_segments(named(50, 90), target, "id", "other", 0).collect()
    assert sum(r["rows"] for r in again if r["batch"] == min(x["batch"] for x in again)) >= 40 and sum(r["rows"] for r in again) <= 60
    assert sorted(r["id"] for r in ST.read_target(spark, target, records().schema).collect()) == sorted(hash_hex(k) for k in range(200))


def hash_hex(k):
    import hashlib

    return hashlib.md5(str(k).encode()).hexdigest()


def test_scorer_failures_are_data(spark):
    def score(batch: pd.DataFrame) -> pd.Series:
        if (batch["v"] == "bad").any():
            raise ValueError("no")
        return batch["v"].str.len()

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "x")], "id long, v string")
    got = {r["id"]: (r["result"], r["error"]) for r in ST.apply_scorer(df, score, "id", "long").collect()}
    assert got == {1: (3, None), 2: (None, "ValueError: no"), 3: (1, None)}


EVENTS = "id long, kind string, at long"


def _event_files(spark, folder, rows, files):
    """`rows` cut into files that a stream reads one by one."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], EVENTS).selectExpr("id", "kind", "timestamp_micros(at) as ts")
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def _event_stream(spark, folder):
    return spark.readStream.schema("id long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def _events(seed, n, first_id=0):
    rng = random.Random(seed)
    return [(first_id + i, rng.choice(("a", "b", None)), None if rng.random() < 0.03 else (i * 400 + rng.randrange(40_000)) * 1_000_000 + rng.randrange(999_999)) for i in range(n)]


def _window_truth(rows):
    hour = 3_600_000_000
    out = {}
    for i, kind, at in rows:
        if at is not None:
            out.setdefault((at // hour * hour, kind), []).append(i)
    return {key: (len(ids), sorted(ids)[:3]) for key, ids in out.items()}


def _run_truth(rows, gap):
    out = []
    for kind in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == kind and r[2] is not None)
        for t in times:
            if out and out[-1][0] == kind and t - out[-1][2] <= gap:
                out[-1] = (kind, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((kind, t, t, 1))
    return sorted(out, key=str)


def test_windows_lose_nothing_over_micro_batches_and_a_resume(spark, tmp_path):
    rows, more = _events(1, 120), _events(2, 40, first_id=1000)
    _event_files(spark, f"{tmp_path}/in", rows, 5)
    count = lambda: ST_STATE.window_counts(_event_stream(spark, f"{tmp_path}/in"), "ts", "kind", "id", "1 hour", "10 minutes", f"{tmp_path}/c", k=3)
    read = lambda df: {(r["s"], r["kind"]): (r["events"], r["details"]) for r in df.selectExpr("unix_micros(window_start) as s", "kind", "events", "details").collect()}
    assert read(count()) == _window_truth(rows)
    assert read(count()) == _window_truth(rows)     # nothing new, nothing twice
    _event_files(spark, f"{tmp_path}/in", more, 2)  # mostly hours that were handed out long ago
    got = count()
    assert read(got) == _window_truth(rows + more)
    first = {(r["kind"], r["id"]): (r["failures"], r["detail_rank"]) for r in ST_STATE.first_details(got, "kind", "id", 3).collect()}
    for kind in ("a", "b", None):
        ids = sorted(i for i, k, at in rows + more if k == kind and at is not None)
        assert all(first[(kind, i)] == (len(ids), rank) for rank, i in enumerate(ids[:3], 1))


def test_runs_lose_nothing_over_micro_batches_and_a_resume(spark, tmp_path):
    rows, more = _events(3, 90), _events(4, 30, first_id=1000)
    _event_files(spark, f"{tmp_path}/in", rows, 4)
    runs = lambda: ST_STATE.gap_runs(_event_stream(spark, f"{tmp_path}/in"), "ts", "kind", "30 minutes", "5 minutes", f"{tmp_path}/c")
    read = lambda df: sorted((tuple(r) for r in df.selectExpr("kind", "unix_micros(run_start)", "unix_micros(run_end)", "parts").collect()), key=str)
    gap = 1_800_000_000
    assert read(runs()) == _run_truth(rows, gap)
    _event_files(spark, f"{tmp_path}/in", more, 3)
    assert read(runs()) == _run_truth(rows + more, gap)


def test_a_stream_without_rows_has_no_windows_and_no_runs(spark, tmp_path):
    spark.createDataFrame([], EVENTS).selectExpr("id", "kind", "timestamp_micros(at) as ts").write.parquet(f"{tmp_path}/in")
    stream = _event_stream(spark, f"{tmp_path}/in")
    assert ST_STATE.window_counts(stream, "ts", "kind", "id", "1 hour", "1 minute", f"{tmp_path}/c1").collect() == []
    assert ST_STATE.gap_runs(stream, "ts", "kind", "1 hour", "1 minute", f"{tmp_path}/c2").collect() == []
