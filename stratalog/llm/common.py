"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as numpy arrays at a time.
SLICE_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The bytes that bytes.split() splits at: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text):
    """Column with A-Z lower-cased and nothing else changed.

    lower() does that for texts that are all ASCII, and is far cheaper than translate().
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with at most `limit` bytes of text (one row at least), with the texts as bytes; null reads as empty."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start), [x or b"" for x in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start), [x or b"" for x in texts.slice(start).to_pylist()]


def named(column: str) -> Column:
    """A column by its whole name, also one with a dot."""
    return F.col("`" + column.replace("`", "``") + "`")


def keep_rows(docs: DataFrame, text: str, judge: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose texts the judge says True of. They are judged where they are; the columns have names of their own meanwhile, as Python workers are asked for them by name."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, at):
                yield part.filter(pa.array(judge(texts), pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def least(keys: DataFrame, wanted: int) -> int | None:
    """The largest of the `wanted` least distinct values of the column h, hashes as longs; all of them are under it if there are fewer, and None stands for no value. Nulls don't count.

    Only hashes under a share of their range reach the driver, a little over `wanted` of them at every size of the table. The share follows from the number of rows, which a table in files knows without being read; it grows where nulls or repeated rows leave too few.
    """
    rows = keys.count()
    share = min(1.0, (1.2 * wanted + 20) / max(1, rows))
    while True:
        top = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
        found = sorted(r.h for r in keys.where(F.col("h") <= F.lit(top)).select("h").distinct().collect())
        if len(found) >= wanted or share >= 1:
            return found[:wanted][-1] if found and wanted else None
        share = min(1.0, 4 * share)


def sample(docs: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """(h, text): at most `rows` different rows with a text, those with the least hashes of id and text. A row that repeats is drawn once."""
    own = docs.select(F.when(F.col(text).isNotNull(), F.xxhash64(F.lit("sample"), doc_id, text)).alias("h"), F.col(text).alias("text"))
    top = least(own.select("h"), rows)
    return own.where(F.lit(False) if top is None else F.col("h") <= top).groupBy("h").agg(F.min("text").alias("text"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder that the session names; its lineage ends there.

    A folder is chosen here only where the session names none and runs on one machine, as in tests.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the session runs."""
    context = spark.sparkContext
    if getattr(context, "_stratalog_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="stratalog-"), "stratalog.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)
    context._stratalog_shipped = True
