"""What the operators share: reading tables, passing texts to Arrow functions, intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table that has the two columns, a null text as the empty one; other columns are pruned from the scan."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def one_of_each(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Of rows that agree on key one: the one whose columns, told as JSON, come first. A key shuffles one partial row a task."""
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    return rows.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("__fm_row")).select("__fm_row.*")


def one_of_each_part(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each part of placed (doc_id, h, part), which has a row for each of docs; h is xxhash64 of the text.

    The smallest doc_id of a part stays, a null one only where all are null; among its texts the one with the smallest hash,
    and of rows that repeat both, one (see one_of_each). What goes is decided by id and text together, so a doc_id that
    stands in several parts loses no part. Rows that neither go nor repeat only meet an anti-join.
    """
    best = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    keys = placed.groupBy("doc_id", "h").agg(F.first("part").alias("part"), F.count(F.lit(1)).alias("times"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    marks = keys.join(best, "part").withColumn("stays", stays).where("not stays or times > 1")
    marks = stored(marks.select(F.col("doc_id").alias("__fm_id"), F.col("h").alias("__fm_h"), F.col("stays").alias("__fm_stays")), "marks")
    rows = docs.withColumns({"__fm_doc": docs[id_col].cast("long"), "__fm_text": F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})
    same = (F.col("__fm_text") == F.col("__fm_h")) & F.col("__fm_doc").eqNullSafe(F.col("__fm_id"))
    alone = rows.join(marks, same, "left_anti").select(*docs.columns)
    repeated = rows.join(marks.where("__fm_stays"), same, "left_semi")
    return alone.unionByName(one_of_each(repeated, ["__fm_doc", "__fm_text"], docs.columns))


#: Rows of an Arrow batch, and bytes of their texts, that are turned into Python objects at once; a longer text stands alone.
STEP, STEP_BYTES = 1024, 4 << 20
#: Spark's limit for the bytes of an Arrow batch that goes to Python; without it 10,000 whole texts stand in the JVM and in Python at once.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def steps(batch: pa.RecordBatch, rows: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in slices of `rows` rows and STEP_BYTES of strings and binaries at most, in order."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, k = np.cumsum(size), 0
    while k < batch.num_rows:
        upto = np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP_BYTES, "right")
        to = min(max(int(upto), k + 1), k + rows)
        yield batch.slice(k, to - k)
        k = to


def _applied(apply: Callable[[pa.RecordBatch], pa.RecordBatch | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            if (out := apply(part)) is not None:
                yield out
        # a worker serves many tasks, and Arrow's pool would keep what its largest batches took
        batch = part = out = None
        pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession) -> None:
    """Where the session does not set Spark's limit for the bytes of an Arrow batch, it is set to STEP_BYTES, for the session."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(STEP_BYTES))


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """df through a function of Arrow batches, cut into steps(). make() runs once a task, so that models and caches are built there and go with it.

    The bytes of a batch are bounded, see bounded_batches().
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _applied(make(), batches)

    return df.mapInArrow(run, schema)
