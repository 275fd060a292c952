"""What the plans must not have."""

import pytest

from ratewatch.plans.queries import queries

SF = "/root/testdata/sf0.001"
PYTHON = {"fc_trend", "fc_arima", "fc_all", "fc_walk_forward", "fc_backtest", "fc_all_days", "fc_ma_profile", "news_model_calls", "news_rss", "news_feed_errors", "news_reply_ledger"}


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - PYTHON))
def test_no_python_and_no_window_without_a_key(spark, name):
    text = plan(spark, name)
    assert "EvalPython" not in text and "InPandas" not in text and "InArrow" not in text
    assert "CartesianProduct" not in text
    if "Window [" in text:
        assert "Exchange SinglePartition, ENSURE_REQUIREMENTS" not in text.split("Window [", 1)[1].split("Scan", 1)[0]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "fx_lookback")
    assert "PushedFilters" in text and "o_custkey" not in text
    assert "WindowGroupLimit" in plan(spark, "news_latest_per_source")
    assert "TakeOrderedAndProject" in plan(spark, "news_latest")


@pytest.mark.parametrize("name", ["fc_trend", "fc_arima", "fc_walk_forward", "fc_ma_profile"])
def test_series_go_through_in_batches(spark, name):
    """One exchange and one sort before the model, no pandas group a series, and no copy of a row for each fold."""
    text = plan(spark, name)
    assert "InPandas" not in text and "MapInArrow" in text
    model = text.split("MapInArrow", 1)[1].split("HashAggregate", 1)[0]
    assert model.count("Exchange") == 1 and "Generate" not in model and "Window" not in model


def test_a_stored_panel_needs_no_exchange(spark, tmp_path):
    """Other months aren't read, and summary, grid and fits find each series in one place."""
    import uuid
    from datetime import date

    from ratewatch.operators import forecast as fc
    from ratewatch.operators import panel
    from ratewatch.plans import tables
    from ratewatch.sources import store

    fx = tables.orders_panel(spark, SF)
    name = f"panel_{uuid.uuid4().hex}"
    seen = store.write_panel(fx, name, str(tmp_path / "panel"), buckets=4)
    counts = panel.ingest_counts(fx).collect()
    assert seen["n"] == sum(r.n for r in counts) and seen["first"] == min(r["first"] for r in counts) and seen["last"] == max(r["last"] for r in counts)
    recent = store.read_panel(spark, name, date(2001, 8, 1))
    assert sorted(recent.collect()) == sorted(panel.lookback(fx, date(2001, 8, 1)).collect())
    for df in (panel.fx_summary(recent), panel.to_business_days(recent), fc.arima_model(dealt=True)(recent, 7), fc.trend_model(dealt=True)(recent, 7)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "PartitionFilters: [isnotnull(month" in text and "Bucketed: true" in text
    # rows that aren't in one place are dealt out
    loose = fc.arima_model(dealt=True)(fx, 7)
    assert "Exchange" in loose._jdf.queryExecution().executedPlan().toString()
    told = lambda df: {(r.series_id, r.step): r.yhat for r in df.collect()}
    assert told(fc.arima_model(dealt=True)(recent, 7)) == pytest.approx(told(fc.arima_model()(panel.lookback(fx, date(2001, 8, 1)), 7)), rel=1e-6)


def test_queries_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    for name in ("fc_ensemble", "fc_walk_forward_baseline", "fc_backtest", "report_posts"):
        queries()[name](spark, SF)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
