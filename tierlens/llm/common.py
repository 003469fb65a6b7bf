"""Columns, written tables and row keys that the operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierlens.session import scratch as fresh_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read back; `removed` takes it away again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes written tables whose last reader has been written itself, and shuffle files with them."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        shuffles_freed(tables[0].sparkSession)


def shuffles_freed(spark: SparkSession) -> None:
    """Spark's cleaner deletes the shuffle files of jobs that nothing refers to any more.

    It does so when the driver's JVM collects garbage; Python's side of a
    DataFrame holds its plan there until its own cycles are collected.
    """
    gc.collect()
    spark._jvm.System.gc()


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Array of the words between ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_text(column: Column) -> Column:
    return column.cast("string")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_text(column).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that an operator is about to add, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that Spark must not broadcast, whichever side it thinks small.

    Spark sizes the rows of an explode or an Arrow function by what goes in,
    and a written table by its compressed files: tables that grow with the
    corpus can be many times as large on the driver as the threshold allows.
    """
    return df.hint("merge")


def hot_lookup(rows: DataFrame, key: str, table: DataFrame, hot: Column) -> DataFrame:
    """Inner join of `rows` with `table`, in which `key` is unique; the few table rows that are `hot` are broadcast.

    The caller proves the bound on the hot rows, and that a row which isn't
    hot can have few partners; so neither side has a key with a large share.
    """
    mark = free_name(rows, "_hot")
    few = table.where(hot).withColumn(mark, F.lit(True))
    tried = rows.join(F.broadcast(few), key, "left")
    rest = tried.where(F.col(mark).isNull()).select(*rows.columns).join(table.where(~hot), key)
    return tried.where(F.col(mark).isNotNull()).drop(mark).unionByName(rest)
