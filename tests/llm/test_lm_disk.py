"""Disk that op6's exchanges hold."""

import glob
import os
import random
import time

from pyspark.sql import functions as F

from lexloom.llm.lm import lm_scores
from lexloom.plans.scratch import materialize


def shuffles(spark):
    out = {}
    for path in glob.glob(spark.conf.get("spark.local.dir") + "/**/shuffle_*.data", recursive=True):
        try:
            out[path] = os.path.getsize(path)
        except FileNotFoundError:
            pass
    return out


def new_bytes(spark, before, most):
    for _ in range(20):
        found = sum(n for path, n in shuffles(spark).items() if path not in before)
        if found <= most:
            break
        time.sleep(0.5)
    return found


def test_shuffles_of_keys_are_deleted(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(500))) for i in range(400)]
    docs, size = spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t) for _, t in rows)
    before = shuffles(spark)
    scores = lm_scores(docs, F.col("doc_id") % 3 > 0)
    assert new_bytes(spark, before, size // 20) <= size // 20
    assert scores.count() == len(rows)


def test_a_write_that_frees_leaves_the_setting_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    assert materialize(spark.range(50).repartition(3), "free", free=True).count() == 50 and spark.conf.get(key) == was
