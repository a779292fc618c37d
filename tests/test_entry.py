import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

from oracle_check import compare, connect  # noqa: E402

import __spark_entry__ as driver  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = ["resample_hourly", "fill_gaps", "feature_build", "look_back_windows", "combined_anomalies", "describe", "best_flags", "reading_scan"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert 0 < len(rows) <= 50 and rows[0]["z_score"] >= rows[-1]["z_score"]


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got = driver.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(driver.oracle_sql()[name]).fetchdf()
    assert compare(got, want) == "ok"


def test_every_headline_query_is_registered():
    import bench

    assert set(bench.HEADLINE) <= set(driver.queries())
