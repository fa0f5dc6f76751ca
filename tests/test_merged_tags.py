"""Tags of merged copies: what is joined, against SQL."""

from conftest import DATA, compare

from quarrymill.plans.registry import ORACLES, QUERIES
from quarrymill.sources import catalog


def test_merged_tags_are_not_compared_row_by_row(spark, duck):
    """no join meets tags, so no task holds both sides of photos' tags and given ones; kept photos meet by id alone."""
    found = QUERIES["D06_merged_tags"](spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert any("LeftAnti" in line for line in joins) and not any("tag_id" in line for line in joins)
    compare(found, duck, ORACLES["D06_merged_tags"])
    assert found.count() > catalog.Catalog(spark, DATA).photo_tags.count()
