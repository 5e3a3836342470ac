"""Tables staged in the shared folder."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from logsentinel.llm.storage import written


def test_groups_of_large_rows(spark):
    """Groups of rows stay small where rows of half a megabyte follow small ones: a reader holds a group as a whole."""

    def rows(batches):
        for _ in batches:
            pass
        for i in range(160):
            size = 100 if i < 2 else 1 << 19
            yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(i).bytes(size)])], names=["x"])

    path = written(spark.range(1).coalesce(1).mapInArrow(rows, "x binary"), "groups", large_rows=True).removeprefix("file://")
    for file in glob.glob(f"{path}/part-*"):
        meta = pq.ParquetFile(file).metadata
        assert meta.num_rows == 160
        assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 12 << 20
