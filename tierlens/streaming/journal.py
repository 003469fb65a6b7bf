"""Incremental, resumable record keeping with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tierlens.sources.journal import journal_issues, plan_hash
from tierlens.sources.manifest import table_fingerprint


#: Segments that a micro-batch is cut into by the hash of the id.
BUCKETS = 16
#: Bits of a segment's filter per id, and places that each id sets; about one id in 2,000 passes wrongly.
FILTER_BITS, FILTER_PLACES = 16, 6
#: Ids whose places are worked out together.
SLICE = 1 << 16


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each id in a filter of so many bits."""
    h = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        every = h[:, None] + step[:, None] * np.arange(FILTER_PLACES, dtype=np.uint64)[None, :]
        return ((every ^ (every >> np.uint64(29))) % np.uint64(bits)).astype(np.int64)


def _filter_of(hashes: np.ndarray) -> bytes:
    """The filter that all these ids pass."""
    bits = np.zeros(-(-FILTER_BITS * len(hashes) // 8) * 8, bool)
    for k in range(0, len(hashes), SLICE):
        bits[_places(hashes[k : k + SLICE], len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def _some_pass(hashes: np.ndarray, packed: bytes) -> bool:
    """Does any of these ids pass a filter?"""
    bits = np.frombuffer(packed, np.uint8)
    for k in range(0, len(hashes), SLICE):
        place = _places(hashes[k : k + SLICE], len(bits) * 8)
        if (((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(1)).any():
            return True
    return False


def _bucketed(records: DataFrame, key: str) -> DataFrame:
    hashed = F.xxhash64(key)
    return records.select("*", hashed.alias("_hash"), F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("bucket"))


def _segment_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("low", kind), T.StructField("high", kind),
        T.StructField("bits", T.BinaryType()),
    ])


def segments(records: DataFrame, key: str) -> DataFrame:
    """One row per bucket of new records: how many, the range of their ids and a filter of them."""

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "bucket": [rows["bucket"].iloc[0]], "rows": [len(rows)], "low": [rows[key].min()], "high": [rows[key].max()], "bits": [_filter_of(rows["_hash"].to_numpy())],
        })

    return _bucketed(records, key).select(key, "_hash", "bucket").groupBy("bucket").applyInPandas(summed, _segment_schema(records.schema[key].dataType))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def hit_segments(ids: DataFrame, target: str, key: str, run: str, batch_id: int) -> DataFrame:
    """(run, batch, bucket, rows) of the segments that may hold one of `ids`.

    Only the segments' ranges and filters are read.  Those of this batch are
    left out: its folder may hold a failed attempt.
    """
    spark, kind = ids.sparkSession, ids.schema[key].dataType
    found = "run string, batch long, bucket int, rows long"
    if not _exists(spark, f"{target}/segments"):      # nothing written yet
        return spark.createDataFrame([], found)
    placed = T.StructType([*_segment_schema(kind).fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    table = spark.read.schema(placed).parquet(f"{target}/segments").where((F.col("run") != run) | (F.col("batch") != batch_id))

    def tested(wanted: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        hit = []
        if len(wanted):
            hashes, values = wanted["_hash"].to_numpy(), wanted[key].to_numpy()
            for low, high, bits in zip(kept["low"], kept["high"], kept["bits"]):
                hit.append(_some_pass(hashes[(values >= low) & (values <= high)], bits))
        return kept.loc[hit if hit else [False] * len(kept), ["run", "batch", "bucket", "rows"]]

    wanted = _bucketed(ids.select(key), key).groupBy("bucket")
    return wanted.cogroup(table.groupBy("bucket")).applyInPandas(tested, found)


def append_once(records: DataFrame, target: str, key: str, plan: str, run: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends records whose id the target lacks.

    A known id is never overwritten.  The same id under another payload or plan
    is an error.  Every batch of a run (one checkpoint) overwrites its own
    folders, so a batch replayed after a lost driver or executor leaves the same
    files.  Records lie in segments, one per batch and bucket of ids; a batch
    reads the segments whose filter one of its ids passes, so what it reads
    follows from its own repeats, not from the journal's size.
    """
    schema = records.schema
    wanted = plan_hash(plan)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            known = _known(batch, target, key, schema, run, batch_id)
            first = batch.groupBy(key).agg(
                F.min_by(F.struct(*batch.columns), F.col("payload_sha256")).alias("r"), F.countDistinct("payload_sha256").alias("_v")
            )
            joined = first.join(known.select(key, F.col("payload_sha256").alias("_old"), F.col("plan_sha256").alias("_plan")), key, "left")
            drift = (F.col("_v") > 1) | (F.col("_old") != F.col("r.payload_sha256")) | (F.col("_plan") != F.col("r.plan_sha256")) | (F.col("r.plan_sha256") != wanted)
            fault = F.raise_error(F.concat(F.lit("journal drift for id "), F.col(key).cast("string")))
            guarded = joined.withColumn("_old", F.when(F.coalesce(drift, F.lit(False)), fault).otherwise(F.col("_old")))
            fresh = _bucketed(guarded.where(F.col("_old").isNull()).select("r.*"), key).drop("_hash")
            own = f"run={run}/batch={batch_id}"
            fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/records/{own}")
            written = spark.read.schema(fresh.schema).parquet(f"{target}/records/{own}")
            segments(written.drop("bucket"), key).write.mode("overwrite").parquet(f"{target}/segments/{own}")
        finally:
            batch.unpersist()

    return write


def _known(batch: DataFrame, target: str, key: str, schema: T.StructType, run: str, batch_id: int) -> DataFrame:
    """Records of all other batches whose ids may be in this one; the list of their segments, a path each, comes to the driver."""
    spark = batch.sparkSession
    hit = hit_segments(batch, target, key, run, batch_id).collect()
    paths = [f"{target}/records/run={s['run']}/batch={s['batch']}/bucket={s['bucket']}" for s in hit]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_target(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/records").select(*schema.names)


def run_journal(stream: DataFrame, target: str, checkpoint: str, key: str, plan: str) -> None:
    """Drains the stream into the journal; a second run resumes after the last finished batch."""
    run = "r" + plan_hash(checkpoint)[:16]
    query = (
        stream.writeStream.foreachBatch(append_once(stream, target, key, plan, run))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def seal(spark: SparkSession, target: str, schema: T.StructType, expected: DataFrame, key: str, plan: str) -> DataFrame:
    """Completion record of a fully covered journal; incomplete or drifted journals raise."""
    journal = read_target(spark, target, schema)
    faults = journal_issues(journal, expected, key, plan).limit(1).collect()
    if faults:
        raise ValueError(f"journal cannot be sealed: {faults[0]['issue']} for {faults[0][key]}")
    return table_fingerprint(journal).withColumn("plan_sha256", F.lit(plan_hash(plan)))


def pending(work: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Work whose id is not completed yet."""
    return work.join(completed.select(key), key, "left_anti")


def apply_scorer(pending_rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], key: str, output: str) -> DataFrame:
    """Runs a caller's scorer over pending records only; a failing record becomes data.

    The scorer gets whole Arrow batches.  Where a batch fails, its records are
    retried one by one, so one bad record does not hide the others.
    """
    kind = pending_rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame({key: batch[key], "result": list(scorer(batch)), "error": None})
            except Exception:
                for k in range(len(batch)):
                    one = batch.iloc[[k]]
                    try:
                        value, error = list(scorer(one))[0], None
                    except Exception as problem:
                        value, error = None, f"{type(problem).__name__}: {problem}"
                    yield pd.DataFrame({key: one[key], "result": [value], "error": [error]})

    return pending_rows.mapInPandas(run, f"{key} {kind}, result {output}, error string")
