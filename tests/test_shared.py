import glob
import os
import tempfile

from pyspark.sql import functions as F

from pageloom.core.shared import CLEANUP_KEY, written


def shuffle_files():
    tops = {tempfile.gettempdir(), os.environ.get("SPARK_LOCAL_DIRS", "/tmp")}
    return {f for top in tops for f in glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*", recursive=True)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(), spark.conf.get(CLEANUP_KEY, None)
    counts = spark.range(1000, numPartitions=8).groupBy((F.col("id") % 7).alias("k")).count()
    table = written(counts.join(counts.withColumnRenamed("count", "n"), "k"), "counts")
    assert not shuffle_files() - before
    assert table.count() == 7 and spark.conf.get(CLEANUP_KEY, None) == setting
