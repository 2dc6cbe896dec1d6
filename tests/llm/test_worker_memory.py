"""A Python worker serves tasks of many stages; what one task needed must not stand beside what the next one needs."""

import weakref

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from fieldmerge.llm import common, packing


def test_chunks_of_packing_go_with_their_task():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    chunks = packing._encoder(path, public_tokenizers.PATTERN)
    ids, gone = chunks.of("some words of a text"), weakref.ref(chunks)
    del chunks
    assert gone() is None
    assert packing._encoder(path, public_tokenizers.PATTERN).of("some words of a text") == ids
    assert packing._encoding(path, public_tokenizers.PATTERN) is packing._encoding(path, public_tokenizers.PATTERN)


def test_the_arrow_pool_gives_back_each_batch_before_the_next(monkeypatch):
    given, left = [], []

    class Pool:
        def release_unused(self):
            left.append(sum(x() is not None for x in given))

    def batches():
        for k in range(3):
            batch = pa.RecordBatch.from_arrays([pa.array([f"{k} {i}" for i in range(3000)])], ["text"])
            given.append(weakref.ref(batch))
            yield batch
            del batch

    class Conf:
        def get(self, name, default=None):
            return "1"

    class Session:
        conf = Conf()

    class Rows:
        sparkSession = Session()

        def mapInArrow(self, run, schema):
            return run(batches())

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    out = [x for part in common.over_batches(Rows(), lambda: lambda part: part, "text string") for x in part.column(0).to_pylist()]
    assert out == [f"{k} {i}" for k in range(3) for i in range(3000)]
    assert len(left) == 3


def test_whole_texts_reach_python_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))

    def sizes():
        return lambda part: pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([sum(x.size for x in part.column(1).buffers() if x)])], ["n", "held"])

    found = common.over_batches(docs, sizes, "n long, held long").collect()
    assert sum(r["n"] for r in found) == 3000
    # a slice keeps the buffers of the batch that it was cut from
    assert max(r["held"] for r in found) <= 2 * common.STEP_BYTES
