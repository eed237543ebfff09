"""What the corpus operators share: stored tables, bounded batches, free names, running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.sources.shared import importable, shared_dir

#: Rows of text that an operator works on at once, and bytes that Spark hands to Python at once (a single longer row is a batch of its own).
TEXT_ROWS, BATCH_BYTES = 256, 8 << 20
#: Rows of keys (two longs at most) that are broadcast: 16 MB. More are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and computes df once
    (checkpoint() computes it twice). The table stays until dropped() or cleared()."""
    spark = df.sparkSession
    importable(spark)
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/tables-{spark.sparkContext.applicationId}/" in path:
            _delete(spark, path)


def cleared(spark: SparkSession) -> None:
    """Delete all tables that this application has stored; results that still read them must be written first."""
    _delete(spark, _own_folder(spark))


def text_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to Python at once by bytes, the same for all operators: a plan reads the setting when it runs."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most. At the end Arrow gives back what it holds: a worker outlives its task."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it one that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that inner columns clash with none of them; unpack with select("row.*")."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a stored table of keys, marked for broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def running_sum(rows: DataFrame, group: list[str], buckets: list[list[str]], inside: list[str], value: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``value`` over the rows before this one in its group.

    ``buckets`` part a group into ordered buckets and those again; rows of the last buckets are ordered by
    ``inside``. Each level is summed and scanned within the bucket above it, so no task holds a group, nor
    the buckets of one. ``rows`` is read twice and must be stored; its columns are the operator's own."""
    keys = [[*group, *(c for b in buckets[:i] for c in b)] for i in range(len(buckets) + 1)]
    sums = stored(rows.groupBy(*keys[-1]).agg(F.sum(value).alias("__sum")), "scan-sums")
    before = None
    for above, here, order in zip(keys, keys[1:], buckets):
        level = sums.groupBy(*here).agg(F.sum("__sum").alias("__sum")) if here != keys[-1] else sums
        level = level.select(*here, (F.sum("__sum").over(Window.partitionBy(*above).orderBy(*order)) - F.col("__sum")).alias("__own"))
        level = level.withColumn("__before", F.col("__own")) if before is None else level.join(before, above).withColumn("__before", F.col("__before") + F.col("__own"))
        before = level.drop("__own")
    here = rows.withColumn("__inside", F.sum(value).over(Window.partitionBy(*keys[-1]).orderBy(*inside)) - F.col(value))
    return here.join(before, keys[-1]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def _lead(hashed: str, bits: int) -> Column:
    return (F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0)).cast("long")


def bucketed(rows: DataFrame, groups: int, n_rows: int, most: int) -> tuple[DataFrame, list[list[str]]]:
    """rows with the columns of ordered buckets of about ``most`` rows, and these by level, for running_sum().

    Buckets are the leading bits of __order, a hash of a row's values, in two levels. Equal rows share a hash:
    a hash of more than ``most`` rows comes after all others, in buckets of its own by a hash of __row."""
    bits = max(0, (n_rows // (groups * most)).bit_length())
    rows = rows.select("*", _lead("__order", bits // 2).alias("__coarse"), _lead("__order", bits).alias("__fine"))
    hot = stored(rows.groupBy("__order").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("__order", F.ceil(F.col("n") / most).alias("__parts")), "scan-hot")
    if hot.first() is None:
        return rows, [["__coarse"], ["__fine"]]
    rows = rows.join(sized_broadcast(hot), "__order", "left")
    is_hot = F.col("__parts").isNotNull()
    tie = F.when(is_hot, F.pmod(F.xxhash64("__row"), "__parts")).otherwise(0)
    rows = rows.withColumns({"__hot": is_hot.cast("int"), "__fine": F.when(is_hot, F.col("__order")).otherwise(F.col("__fine")), "__tie": tie}).drop("__parts")
    return rows, [["__hot", "__coarse"], ["__fine"], ["__tie"]]
