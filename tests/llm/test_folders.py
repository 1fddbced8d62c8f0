import threading

import numpy as np
from pyspark.sql import functions as F

from botlantern.llm.common import FILTER_BITS, MOST_BITS, bit_filter, clean, filter_bits, named, passes, stored


def test_cleaning_leaves_what_another_run_has_stored(spark):
    begun, found = named(), {}

    def other():
        found["theirs"] = stored(spark.range(3).toDF("a"), "theirs")

    beside = threading.Thread(target=other)
    beside.start()
    mine = stored(spark.range(5).toDF("a"), "mine")
    beside.join()
    assert mine.count() == 5
    clean(spark, begun)
    assert found["theirs"].count() == 3 and named() == begun


def test_filters_grow_with_what_they_hold(spark):
    assert filter_bits(0) == filter_bits(1000) == FILTER_BITS and filter_bits(10**12) == MOST_BITS
    sizes = [filter_bits(n) for n in (10**5, 10**6, 10**7)]
    assert sizes == sorted(sizes) and all(s >= 10 * n for s, n in zip(sizes, (10**5, 10**6, 10**7), strict=True)) and all(s & (s - 1) == 0 for s in sizes)
    hashes = spark.range(1000).select(F.xxhash64("id").alias("hash"))
    bits = bit_filter(hashes, FILTER_BITS * 4)
    inside = np.array([r.hash for r in hashes.collect()], dtype=np.int64).view(np.uint64)
    other = np.array([r.hash for r in spark.range(5000, 9000).select(F.xxhash64("id").alias("hash")).collect()], dtype=np.int64).view(np.uint64)
    assert passes(bits, inside).all() and passes(bits, other).mean() < 0.01
