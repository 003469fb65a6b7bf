"""Observation journals: JSON lines with payload and plan hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierlens.functions.labels import named_issues


def plan_hash(plan: str) -> str:
    """Identity of the inputs and settings a journal was written under."""
    import hashlib

    return hashlib.sha256(plan.encode()).hexdigest()


def payload_hash(payload: Column | str, plan: Column | str, key: Column | str) -> Column:
    """SHA-256 over key, plan hash and payload text."""
    return F.sha2(F.concat_ws("\n", F.col(key).cast("string") if isinstance(key, str) else key, plan, payload), 256)


def seal_records(observations: DataFrame, key: str, payload: Sequence[str], plan: str) -> DataFrame:
    """Journal records: key, payload as JSON text, plan hash, payload hash."""
    text = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    out = observations.select(key, text.alias("payload"), F.lit(plan_hash(plan)).alias("plan_sha256"))
    return out.withColumn("payload_sha256", payload_hash(F.col("payload"), F.col("plan_sha256"), F.col(key).cast("string")))


def journal_schema(key: str, kind: T.DataType) -> T.StructType:
    fields = [T.StructField(key, kind)] + [T.StructField(c, T.StringType()) for c in ("payload", "plan_sha256", "payload_sha256")]
    return T.StructType(fields)


def read_journal(spark: SparkSession, path: str, key: str, kind: T.DataType) -> DataFrame:
    """JSON-lines scan; columns are fixed, so nothing is inferred."""
    return spark.read.schema(journal_schema(key, kind)).option("mode", "FAILFAST").json(path)


def journal_issues(journal: DataFrame, expected: DataFrame, key: str, plan: str) -> DataFrame:
    """Integrity faults per id: payload or plan drift, repeats, missing or unexpected ids."""
    proof = payload_hash(F.col("payload"), F.col("plan_sha256"), F.col(key).cast("string"))
    seen = journal.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.equal_null("payload_sha256", proof)).alias("_ok"),
        F.bool_and(F.col("plan_sha256") == plan_hash(plan)).alias("_plan"),
    )
    wanted = expected.select(key).distinct().withColumn("_want", F.lit(True))
    joined = seen.join(wanted, key, "full_outer")
    c = F.col
    return joined.select(
        key,
        F.explode(
            named_issues(
                [
                    ("payload_drift", ~c("_ok")), ("plan_drift", ~c("_plan")), ("duplicate_id", c("_n") > 1),
                    ("missing", c("_n").isNull()), ("unexpected", c("_want").isNull()),
                ]
            )
        ).alias("issue"),
    )
