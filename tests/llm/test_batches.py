"""What a Python worker is sent at once is bounded in bytes, and settings come back."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaweave.llm import common


def test_stored_sends_batches_of_bounded_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    before = spark.conf.get(common.BATCH)
    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    got = common.stored(texts.mapInArrow(sizes, "bytes long, rows long")).agg(F.max("bytes").alias("most"), F.sum("rows").alias("rows")).first()
    assert got.rows == 3000 and got.most < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH) == before


def test_settings_come_back_after_an_error(spark):
    before = spark.conf.get(common.BATCH)
    with pytest.raises(ValueError), common.settings(spark, {common.BATCH: "1048576"}):
        assert spark.conf.get(common.BATCH) == "1048576"
        raise ValueError
    assert spark.conf.get(common.BATCH) == before
