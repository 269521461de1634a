"""A finished step's shuffle files don't stay beside the next one's."""

import glob
import time

from pyspark.sql import functions as F

from relflow.llm import common as C


def test_storing_drops_the_shuffle_files_of_finished_steps(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    step = C.stored(spark.range(200_000).repartition(7, F.col("id")))
    mine = files() - before
    assert mine and step.count() == 200_000
    C.stored(spark.range(5))
    until = time.time() + 20
    while mine & files() and time.time() < until:
        time.sleep(0.2)
    assert not mine & files()
