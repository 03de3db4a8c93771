"""Settings that the operators read."""

import pytest

from kiln.llm.shared import BATCH_BYTES, bounded_batches, size_of

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("text, size", [("8388608", 1 << 23), ("64m", 64 << 20), ("64MB", 64 << 20), ("1g", 1 << 30), ("5b", 5), ("2kb", 2048), ("268435456b", 1 << 28)])
def test_sizes(text, size):
    assert size_of(text) == size


def test_batches_are_lowered_only(spark):
    before = spark.conf.get(KEY)
    try:
        for given, left in (("64m", str(BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(KEY, given)
            bounded_batches(spark)
            assert size_of(spark.conf.get(KEY)) == size_of(left)
    finally:
        spark.conf.set(KEY, before)
