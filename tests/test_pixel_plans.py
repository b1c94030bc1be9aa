"""Few rows that become many pixels: how they are dealt and joined."""

from pyspark.sql import functions as F

from inkveil.plans import pixel_queries
from inkveil.plans.pixel_queries import _image
from inkveil.sources import ocr


def _made(spark, n=9):
    return _image(spark.range(1, n + 1).coalesce(1), "id", 3, 2, lambda k, j: (k + j, k * 2 + j * 0, j + k * 0))


def test_pictures_do_not_broadcast_pixels(spark):
    images = _made(spark)
    crop = F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 2.0), ("y1", 1.0))])
    asked = images.select("image_id", F.concat(F.lit("r"), "image_id").alias("request_id"), F.lit("source").alias("variant"), F.lit(1.0).alias("zoom"), crop.alias("crop"))
    got = ocr.pictures(asked, images)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["request_id"]: (r["width"], r["height"], bytes(r["data"])) for r in got.collect()}
    assert len(rows) == 9 and rows["r4"] == (2, 1, bytes([4, 8, 0, 255, 5, 8, 1, 255]))


def test_images_are_dealt_over_all_cores(spark):
    made = _made(spark, 5000)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.filter(F.length("data") == 24).count() == 5000


def test_page_pictures_are_dealt_over_all_cores(spark, sf_dir):
    assert pixel_queries.page_pictures(spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_embeddings_are_dealt_over_all_cores(spark, sf_dir):
    assert pixel_queries.template_scores(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
