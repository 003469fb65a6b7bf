"""Stable hashes: rank keys, record fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_rank(seed: int, *parts: Column | str) -> Column:
    """SHA-256 of the compact JSON array [seed, part, ...]; hex order = byte order."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat(F.lit(f"[{seed},"), F.substr(F.to_json(F.array(*columns)), F.lit(2))), 256)


def tagged_hash(prefix: str, key: Column) -> Column:
    """SHA-256 of '<prefix><key>'."""
    return F.sha2(F.concat(F.lit(prefix), key.cast("string")), 256)


def record_hash(df: DataFrame) -> Column:
    """SHA-256 of one record in canonical form (columns sorted by name, nulls kept)."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
