import time

from pyspark.sql import functions as F

from inkveil.llm.common import cut

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_a_written_step_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if "shuffle_" in str(f)}
    kept = spark.range(20000).groupBy((F.col("id") % 7).alias("k")).count()
    before, held = spark.conf.get(FREE_SHUFFLES), files()
    rows = cut(kept)
    ends = time.time() + 20
    while (left := files() - held) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(FREE_SHUFFLES) == before
    # The step can be read again, and so can what it was made of.
    assert sorted(rows.collect()) == sorted(rows.collect()) == sorted(kept.collect())
