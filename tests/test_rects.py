"""A rectangle's text is read once a row, and by its form alone."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarrymill.functions import scalars as sc
from quarrymill.plans.base import QUERIES


def test_texts_are_parsed_once(spark):
    """F19"""
    plan = QUERIES["X24_rects"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('\n\t{"x": 1, "y": 2.5, "width": 3, "height": 4}', [1, 2.5, 3, 4]), ('[{"x": 1, "y": 2, "width": 3, "height": 4}]', None), ('1 2 3 4 <rect x="a" y="2" width="3" height="4"/>', [1, 2, 3, 4]),
        ('a <rect  x="1.5" y="2"\nwidth="3" height="4"', [1.5, 2, 3, 4]), ('{"x": 1, "y": 2, "width": 3}', None), (None, None), ("", None), ("1.5  2\t3 4.25 more", [1.5, 2, 3, 4.25]),
    ],
)
def test_forms(spark, text, want):
    made = spark.createDataFrame([(text,)], "t string").select(sc.rect_struct(F.col("t")).alias("r")).first()["r"]
    assert (None if made is None else list(made)) == want
