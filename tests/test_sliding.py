import numpy as np
import pandas as pd
import pytest
from helpers import series, to_spark

from tidemark.plans.positions import DAY, HOUR, Layout
from tidemark.plans.sliding import STATS, sliding


def expected(v, window, include_current, least):
    past = v if include_current else v.shift(1)
    frames = past.rolling(window, min_periods=1)
    # rows before the series' start don't count towards a frame
    n = frames.count()
    out = {s: getattr(frames, s)().where(n >= least) for s in STATS}
    return out


@pytest.mark.parametrize("window,chunk,current,least", [
    (6, 100, False, 6), (6, 6, True, 6), (24, 5, False, 24), (24, 7, True, 3), (50, 8, False, 1), (2, 64, True, 2), (1, 4, False, 1), (400, 16, False, 2),
])
def test_equals_pandas(spark, window, chunk, current, least):
    parts = [series(n, seed=n, gaps=0.2, nulls=0.2).assign(k=k) for k, n in (("a", 220), ("b", 40), (None, 3))]
    parts[0].loc[60:100, "v"] = np.nan
    df = to_spark(spark, pd.concat(parts)).repartition(5)
    for layout in (Layout("sliced", 9 * HOUR, chunk), Layout("keyed", DAY, chunk)):
        got = sliding(df, "v", window, include_current=current, min_values=least, keys=["k"], layout=layout).toPandas()
        assert len(got) == sum(map(len, parts))
        for part in parts:
            key = part["k"].iloc[0]
            mine = got[got["k"].isna() if key is None else got["k"] == key].sort_values("ts")
            for s, want in expected(part["v"], window, current, least).items():
                np.testing.assert_allclose(mine[f"sliding_{s}_{window}"].astype(float), want, atol=1e-9, err_msg=f"{key} {s}")


def test_large_values_keep_their_digits(spark):
    pdf = series(300, seed=4)
    pdf["v"] = pdf["v"] + 1e9
    got = sliding(to_spark(spark, pdf).repartition(3), "v", 40, layout=Layout("sliced", DAY, 16)).toPandas().sort_values("ts")
    want = (pdf["v"] - 1e9).shift(1).rolling(40).std()
    np.testing.assert_allclose(got["sliding_std_40"].astype(float), want, rtol=1e-6)


def test_cost_does_not_grow_with_the_window(spark):
    """No window of the plan reaches back further than the running frames do."""
    df = to_spark(spark, series(50))
    plans = [sliding(df, "v", w, layout=Layout("sliced", DAY, 1000))._jdf.queryExecution().optimizedPlan().toString() for w in (10, 900)]
    assert [p.count("Window") for p in plans] == [plans[0].count("Window")] * 2
    assert not any("-900" in p for p in plans)


def test_edges(spark):
    df = to_spark(spark, series(10))
    with pytest.raises(ValueError):
        sliding(df, "v", 1, include_current=True)
    assert sliding(df.limit(0), "v", 5).count() == 0
    assert sliding(df, "v", 5, stats=["max"]).columns == ["ts", "v", "sliding_max_5"]
