"""Sums of count blobs reach the driver in one job."""

import numpy as np

from pubmetrics.llm import store


def test_sums_of_blobs_are_one_job(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in names]
    counts = np.arange(1000)
    rows = [r for _ in range(3) for r in store.blob_rows("x", counts, 16)]
    try:
        for k, v in zip(names, ("40", "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("blobs", "blobs")
        found = store.summed_blobs(spark.createDataFrame(rows, store.BLOBS))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("blobs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    assert found["x"].tolist() == (3 * counts).tolist()
    assert len(jobs) <= 3
