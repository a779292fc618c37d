from pathlib import Path

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


def test_sarima_scores_the_whole_test_part(spark):
    assert driver.queries()["sarima_forecast"](spark, SF).count() == 500
