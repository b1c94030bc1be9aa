"""What lambdas read is made once: a plan repeats no array that they go through."""

from pyspark.sql import functions as F

from inkveil.functions.spatial import cluster
from inkveil.operators.units import line_units
from inkveil.plans import run_queries


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_symbols_of_a_word_are_made_once(spark, sf_dir):
    pages = run_queries._pages(run_queries._parts(spark, sf_dir))
    # The words with their normal forms, and a word's symbols with theirs.
    assert plan(line_units(pages)).count("zip_with(") - plan(pages).count("zip_with(") == 2


def test_a_candidate_looks_for_its_group_once(spark):
    box = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
    found = plan(spark.range(1).select(cluster(F.array(F.struct(box.alias("box")))).alias("g")))
    assert found.count("array_position(") == 1
