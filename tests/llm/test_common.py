import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from ledgerlens.llm import common


def test_bit_filter(spark, monkeypatch):
    """The pipeline's F1: a task filled 128 MB, whatever blocks it had."""
    tops = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << common.FILTER_BITS, 3_000), [0, 1, 7, 8, 32_767, 32_768, (1 << common.FILTER_BITS) - 1]]))
    hashes = (tops.astype(np.uint64) << np.uint64(64 - common.FILTER_BITS)) + np.uint64(5)
    tasks, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: tasks.append(run) or real(self, run, schema))
    bits = common.bit_filter(spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long"))
    assert np.array_equal(np.flatnonzero(np.unpackbits(bits, bitorder="little")), tops)
    assert common.in_filter(bits, hashes).all() and not common.in_filter(bits, hashes[:1] + np.uint64(1 << 38)).any()

    batches = [pa.RecordBatch.from_pydict({"top": pa.array(x, pa.int64())}) for x in (tops[::2], tops[1::2], tops[:0])]
    tracemalloc.start()
    try:
        blocks = pa.Table.from_batches(list(tasks[0](iter(batches)))).to_pylist()
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert len(blocks) == len(np.unique(tops >> common.BLOCK_BITS)) and all(len(b["bits"]) == 4096 for b in blocks)
