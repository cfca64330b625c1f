"""What the operators share: checkpointing, bounded batches, joins without hot keys and rows dropped without a shuffle."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that a worker turns into Python values at once; a longer text comes alone.
MOST_BYTES, MOST_ROWS = 2 << 20, 1024
#: A key with more than one in so many rows is heavy. There are at most as many heavy keys, whatever the data, so they can be broadcast.
HEAVY = 10_000
#: Checkpoints after which the driver frees what they replaced.
COLLECT = 6
_steps = 0
#: Bits of the map that tells which keys may be dropped: 32 MB at most.
MOST_BITS = 1 << 28


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder the cluster names in ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="planeweave-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that a lost executor costs no rerun.

    What earlier steps left behind (shuffles, broadcasts, checkpoints, plans) is freed only when the driver collects its garbage, so
    that is asked for once in ``COLLECT`` steps.
    """
    global _steps
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    _steps += 1
    if _steps % COLLECT == 0:
        spark.sparkContext._jvm.System.gc()
    return out


def bounded(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``MOST_BYTES`` of the column ``name`` and ``MOST_ROWS`` rows, but one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + MOST_BYTES
            stop = min(max(at + 1, int(np.searchsorted(ends, most, side="right"))), at + MOST_ROWS)
            yield batch.slice(at, stop - at)
            at = stop


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is an empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores at its end as many as make it none of ``df``'s columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def join_by(left: DataFrame, right: DataFrame, key: str, count: str, total: int, keys: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``count`` how many of ``left``'s ``total`` rows have it.

    Up to ``HEAVY`` keys are broadcast. Of more, only the heavy ones are, which are no more than that: their rows stay where they
    are, and the rest is shuffled, of which no key has more than one in ``HEAVY`` rows. ``keys`` is at least the number of ``right``'s
    rows, where that is known. ``count`` is left out.
    """
    if (right.limit(HEAVY + 1).count() if keys is None else keys) <= HEAVY:
        return left.join(F.broadcast(right.drop(count)), key)
    heavy = right.where(F.col(count) * HEAVY > total).drop(count)
    light = right.where(F.col(count) * HEAVY <= total).drop(count)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def split_by(df: DataFrame, keys: DataFrame, n_keys: int, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` is surely none of ``keys``, the others), both without a shuffle of ``df``.

    ``keys`` has one column, ``n_keys`` about its rows. Its hashes set bits of a map of 16 bits a key, ``MOST_BITS`` at most, which is
    broadcast; beyond that size more rows count as others, and none of ``keys`` is ever missed. A null key is surely none.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * n_keys).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    at = place(F.col(keys.columns[0]))
    held = keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    held = F.broadcast(cut_lineage(held))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # so that no name clashes
    here = df.select(row, F.when(key.isNotNull(), F.bitmap_bucket_number(place(key))).alias("_bucket"), F.bitmap_bit_position(place(key)).alias("_place"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0, F.lit(False))
    told = here.join(held, "_bucket", "left").withColumn("_set", is_set)
    return told.where(~F.col("_set")).select("row.*"), told.where("_set").select("row.*")
