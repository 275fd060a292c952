"""Parsing, edge cases and invariants that the shared tables don't show."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewatch.functions import any_keyword, day_first_date, decimal_number, guarded_ratio, money, percent_change, prefix, published_at, signed, split_once
from ratewatch.operators import forecast as fc
from ratewatch.operators import models as m
from ratewatch.operators import news, panel, report
from ratewatch.operators.holidays import colombian, easter
from ratewatch.plans.daily import run_daily, run_landed
from ratewatch.sources import ledger, rates, sinks
from ratewatch.sources.markup import feed_entries, table_rows
from ratewatch.sources.news import read_feeds, read_news_json

FX = "series_id string, ds date, y double"
ARTICLE = "url string, title string, summary string, published_at timestamp, source string, tags array<string>, feed_rank int, entry_seq bigint"
RUN = datetime(2024, 6, 1, 12)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def business_days(n, start="2023-01-02"):
    days = np.datetime64(start) + np.arange(2 * n + 7)
    return [d.astype(object) for d in days[np.is_busday(days)][:n]]


def series(spark, n, y=lambda i: 4000 + 0.5 * i, name="a"):
    return spark.createDataFrame([(name, d, float(y(i))) for i, d in enumerate(business_days(n))], FX)


# -- functions


def test_dates_and_numbers(spark):
    assert one(spark, day_first_date(F.col("s")), s="31/01/2024") == date(2024, 1, 31)
    assert one(spark, day_first_date(F.col("s")), s="01-31") is None
    assert one(spark, decimal_number(F.col("s")), s="3950,25") == 3950.25
    assert one(spark, decimal_number(F.col("s")), s="3.950,25") is None
    assert one(spark, decimal_number(F.col("s"), thousands="."), s="3.950,25") == 3950.25
    assert one(spark, percent_change(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, guarded_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) == pytest.approx(1e9)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Sat, 01 Jun 2024 10:30:00 GMT", datetime(2024, 6, 1, 10, 30)), ("Sat, 1 Jun 2024 05:30:00 -0500", datetime(2024, 6, 1, 10, 30)), ("2024-06-01T10:30:00Z", datetime(2024, 6, 1, 10, 30)), ("yesterday", RUN), (None, RUN)],
)
def test_publication_times(spark, text, wanted):
    got = spark.createDataFrame([(text,)], "s string").select(F.date_format(published_at(F.col("s"), F.lit("2024-06-01 12:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("x")).first().x
    assert got == wanted.strftime("%Y-%m-%d %H:%M")


def test_texts(spark):
    assert one(spark, any_keyword(F.col("s"), ["interés"]), s="SUBE EL INTERÉS") is True
    assert one(spark, prefix(F.col("s"), 2), s="🙂🙂🙂") == "🙂🙂"
    assert one(spark, money(F.col("x")), x=4050.0) == "4,050.00" and one(spark, signed(F.col("x")), x=1.25) == "+1.25"
    before, after = split_once(F.col("s"))
    assert one(spark, before, s="a \n---\n b --- c\n") == "a" and one(spark, after, s="a \n---\n b --- c\n") == "b --- c" and one(spark, after, s="a") == ""


# -- sources


def test_rates_json(spark, tmp_path):
    good = '{"Meta Data": {"1": "x"}, "Time Series FX (Daily)": {"2024-01-02": {"1. open": "1", "4. close": "3900.5"}, "2024-01-03": {"4. close": "3901"}}}'
    for name, text in {"good": good, "limit": '{"Note": "too many calls"}', "wrong": '{"Error Message": "no such pair", "Note": "n"}', "broken": "{{{", "text": good.replace("3901", "n/a")}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, errors = rates.read_rates_json(spark, str(tmp_path))
    assert {(r.series_id, str(r.ds), r.y) for r in rows.collect()} == {("good", "2024-01-02", 3900.5), ("good", "2024-01-03", 3901.0)}
    assert {r.series_id: r.message for r in errors.collect()} | {"text": ""} == {"limit": "too many calls", "wrong": "no such pair", "broken": "unreadable payload", "text": ""}
    assert "text" in {r.series_id for r in errors.collect()}
    backup = spark.createDataFrame([("good", date(2020, 1, 1), 1.0), ("limit", date(2020, 1, 1), 2.0)], FX)
    assert {r.series_id: r.y for r in rates.with_fallback(rows, backup).where("ds < '2021-01-01'").collect()} == {"limit": 2.0}


def test_rates_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("fecha;valor\n31/01/2024;3950,25\nbad;1\n01/02/2024;x\n")
    assert [(str(r.ds), r.y) for r in rates.read_rates_table(spark, str(tmp_path / "t.csv"), "COP").collect()] == [("2024-01-31", 3950.25)]
    (tmp_path / "t.html").write_text("<table><tr><th>d</th></tr><tr class='a'><td>31/01/2024</td><td><b>3950,25</b></td></tr></table>")
    assert [(str(r.ds), r.y) for r in rates.read_rates_html(spark, str(tmp_path / "t.html"), "COP")[0].collect()] == [("2024-01-31", 3950.25)]
    (tmp_path / "none.html").write_text("<p>no table")
    rows, errors = rates.read_rates_html(spark, str(tmp_path / "*.html"), "COP")
    assert rows.count() == 1 and [r.message.split(":")[0] for r in errors.collect()] == ["no table rows"]


def test_table_rows():
    nested = "<table><tr><td>a<table><tr><td>x</td><td>y &amp; z</td></tr></table>b</td><td>c</td><tr><td>open<td>row"
    assert table_rows(nested.encode()) == ([["x", "y & z"], ["ab", "c"], ["open", "row"]], None)
    assert table_rows(b"") == ([], "no table rows")


def test_feeds_of_all_kinds():
    rss = "<rss><channel><image><title>no</title></image><title>F &amp; G</title><item><title><![CDATA[a &nbsp; b]]></title><link> u </link><description>x&nbsp;y</description><pubDate>d</pubDate></item><item/></channel></rss>"
    assert feed_entries(rss.encode()) == ("F & G", [("a &nbsp; b", "x\u00a0y", "u", "d"), (None, None, None, None)], None)
    rdf = "<rdf:RDF xmlns:rdf='r' xmlns='http://purl.org/rss/1.0/' xmlns:dc='d'><channel><title>R</title></channel><item><title>t</title><link>u</link><dc:date>2024</dc:date></item></rdf:RDF>"
    assert feed_entries(rdf.encode()) == ("R", [("t", None, "u", "2024")], None)
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><title type='xhtml'><div>t <b>b</b></div></title><link rel='self' href='s'/><link href='u'/><content>c</content><updated>2024</updated></entry></feed>"
    assert feed_entries(atom.encode()) == ("A", [("t b", "c", "u", "2024")], None)
    title, entries, error = feed_entries(rss.replace("<item/>", "<item><title>cut").encode())
    assert len(entries) == 1 and error.startswith("broken after 1 entries")
    latin = "<?xml version='1.0' encoding='iso-8859-1'?><rss><channel><title>é</title></channel></rss>".encode("latin-1")
    assert feed_entries(latin) == ("é", [], "no entries")
    for broken in (b"", b"\0\1", b"not xml", b"<rss>"):
        assert feed_entries(broken)[2]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><title>Feed</title><item><title>T</title><description>D</description><link>u1</link><pubDate>Sat, 01 Jun 2024 10:30:00 GMT</pubDate></item><item><title>T2</title></item></channel></rss>")
    (tmp_path / "n.json").write_text('{"articles":[{"title":null,"description":"d","url":"u2","publishedAt":"2024-06-01T00:00:00Z","source":{"name":null}}]}')
    run_ts = F.lit("2024-06-02 00:00:00").cast("timestamp")
    rss, errors = read_feeds(spark, str(tmp_path / "a.xml"), run_ts)
    rows = rss.orderBy("entry_seq").collect()
    assert [(r.url, r.title, r.summary, r.source) for r in rows] == [("u1", "T", "D", "Feed"), ("", "T2", "", "Feed")]
    assert errors.count() == 0
    api, _ = read_news_json(spark, str(tmp_path / "n.json"), run_ts)
    r = api.first()
    assert (r.url, r.title, r.source, r.tags) == ("u2", "", "NewsAPI", [])


def test_each_file_gives_rows_or_an_error(spark, tmp_path):
    run_ts = F.lit("2024-06-02 00:00:00").cast("timestamp")
    for name, text in {"a.json": '{"articles":[{"title":"t","source":"one"},{"title":"u"}]}', "b.json": '{"articles":[]}', "c.json": '{"status":"error"}', "d.json": "[1", "e.json": '{"articles":{"title":"x"}}', "f.json": ""}.items():
        (tmp_path / name).write_text(text)
    rows, errors = read_news_json(spark, str(tmp_path / "*.json"), run_ts)
    assert [(r.title, r.entry_seq) for r in rows.collect()] == [("u", 1)]
    assert sorted((r.series_id[-6:], r.message) for r in errors.collect()) == [("a.json", "unreadable article 0"), ("b.json", "no articles"), ("c.json", "unreadable file"), ("d.json", "unreadable file"), ("e.json", "unreadable file"), ("f.json", "empty file")]
    (tmp_path / "a.xml").write_text("")
    (tmp_path / "b.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><title>t</title><link href='u'/><updated>2024-06-01T10:00:00+02:00</updated></entry>")
    rows, errors = read_feeds(spark, str(tmp_path / "*.xml"), run_ts)
    r = rows.first()
    assert (r.title, r.source, r.published_at) == ("t", "A", datetime(2024, 6, 1, 8)) and rows.count() == 1
    assert {r.series_id[-5:] for r in errors.collect()} == {"a.xml", "b.xml"}


def test_reports_replace_their_own_date(spark, tmp_path):
    path = str(tmp_path / "out")
    for day, text in (("2024-06-01", "a"), ("2024-06-02", "b"), ("2024-06-01", "c")):
        sinks.write_reports(spark.createDataFrame([("s", day, text)], "series_id string, run_date string, report string"), path)
    assert {str(r.run_date): r.report for r in spark.read.parquet(path).collect()} == {"2024-06-01": "c", "2024-06-02": "b"}


def test_outbox(spark):
    posts = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y" * 281)], "series_id string, post string")
    ready, errors = sinks.post_outbox(posts, enabled=True)
    assert [(r.series_id, r.status) for r in ready.collect()] == [("a", "ready")] and [r.series_id for r in errors.collect()] == ["c"]


# -- panel


@pytest.mark.parametrize(("n", "reference"), [(1, 0), (29, 0), (30, 0), (31, 1), (100, 70)])
def test_reference_is_the_thirtieth_from_the_end(spark, n, reference):
    r = panel.fx_summary(series(spark, n)).first()
    assert (r.latest_rate, r.reference_rate) == (4000 + 0.5 * (n - 1), 4000 + 0.5 * reference)


def test_lookback_has_both_ends(spark):
    fx = spark.createDataFrame([("a", date(2024, 1, d), 1.0) for d in range(1, 32)], FX)
    assert [r.ds.day for r in panel.lookback(fx, date(2024, 1, 20), 5).orderBy("ds").collect()] == list(range(15, 21))
    assert panel.lookback(fx, date(2024, 1, 31), 0).count() == 31


def test_business_days(spark):
    rows = [("a", date(2024, 1, 6), 9.0), ("a", date(2024, 1, 8), 1.0), ("a", date(2024, 1, 13), 5.0), ("a", date(2024, 1, 14), 6.0), ("b", date(2024, 1, 8), 1.0), ("b", date(2024, 1, 8), 2.0), ("c", date(2024, 1, 6), 1.0)]
    fx = spark.createDataFrame(rows, FX)
    got = [(r.series_id, r.ds.day, r.y) for r in panel.to_business_days(fx).orderBy("series_id", "ds").collect()]
    assert got == [("a", d, 1.0) for d in range(8, 13)]
    assert [r.series_id for r in panel.grid_errors(fx).collect()] == ["b"]
    assert [r.ds.day for r in panel.future_business_days(fx.where("series_id = 'a'"), 3).orderBy("step").collect()] == [15, 16, 17]


# -- news


def article(spark, rows):
    return spark.createDataFrame([(u, t, s, p, "src", [], rank, seq) for u, t, s, p, rank, seq in rows], ARTICLE)


def test_first_wins_and_newest_first(spark):
    rows = article(spark, [("u", "old", "", RUN, 1, 0), ("u", "first", "", RUN, 0, 5), ("", "e1", "", RUN, 0, 1), ("", "e2", "", RUN, 0, 2), ("v", "v", "", RUN, 2, 0)])
    once = news.dedup_by_url(rows)
    assert {r.title for r in once.collect()} == {"first", "e1", "v"}
    assert news.dedup_by_url(once).count() == 3
    assert [r.title for r in news.latest_articles(once, 2).collect()] == ["e1", "first"]
    assert "TakeOrderedAndProject" in news.latest_articles(once, 2)._jdf.queryExecution().toString()


def test_replies(spark):
    rows = article(spark, [(f"u{i}", f"t{i}", "dólar" if i == 1 else "", RUN, 0, i) for i in range(3)]).withColumn("batch", F.lit("b"))
    reply = '[{"index": 0, "topic": "trade"}, {"index": 0, "topic": "macro", "bullish_cop": true}, {"index": 9, "topic": "x"}, {"topic": "none"}]'
    replies = lambda raw: spark.createDataFrame([("b", raw)], "batch string, raw string")
    got = {r.title: r for r in news.classify(rows, replies(reply)).collect()}
    assert len(got) == 3 and (got["t0"].topic, got["t0"].bullish_cop) == ("macro", True) and (got["t1"].topic, got["t1"].severity) == ("other", "low")
    for raw in ("not valid json at all {{{", '{"index": 0}', "[1", None):
        got = {r.title: r for r in news.classify(rows, replies(raw)).collect()}
        assert len(got) == 3 and got["t1"].severity == "high" and got["t0"].reasoning == news.FALLBACK_REASON
    parsed = news.parse_reply(replies('[{"index": 1}]\n---\n text --- more \n')).first()
    assert parsed.narrative == "text --- more" and len(parsed.items) == 1
    assert news.parse_reply(replies("oops")).first().narrative == news.NO_ANALYSIS


def test_a_failing_call_is_one_failed_batch(spark):
    def fn(texts):
        if "bad" in texts[0]:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    got = {r.batch: r.raw for r in news.call_model(spark.createDataFrame([("a", "good"), ("b", "bad")], "batch string, digest string"), fn).collect()}
    assert got == {"a": "GOOD", "b": None}


# -- forecasts


def test_models_on_a_trend(spark):
    fx = series(spark, 200, lambda i: 4000 + 0.5 * i + np.random.default_rng(i).normal(0, 20)).unionByName(series(spark, 2, name="short"))
    good, errors = fc.forecast_all(fx, {"trend": fc.trend_model(), "arima": fc.arima_model()}, 5)
    rows = good.collect()
    long = [r for r in rows if r.series_id == "a"]
    assert len(long) == 10 and all(r.yhat > 0 and r.yhat_lower <= r.yhat <= r.yhat_upper and r.ds.weekday() < 5 for r in long)
    assert all(abs(r.yhat - 4100) < 60 for r in long)
    assert {r.series_id for r in errors.collect()} == {"short"}
    both, uneven = fc.ensemble(good)
    assert both.where("series_id = 'a'").count() == 5 and uneven.count() == 0


def test_models_find_their_own_parameters():
    rng = np.random.default_rng(0)
    e, w = rng.normal(0, 1, 1500), np.zeros(1500)
    for t in range(2, 1500):
        w[t] = 0.5 * w[t - 1] - 0.3 * w[t - 2] + e[t]
    y = 1000 + w.cumsum()
    center, low, high = m.arima_forecasts([y], 1)[0]
    step = 0.5 * w[-1] - 0.3 * w[-2]
    assert abs(center[0] - y[-1] - step) < 0.3 and abs((high - low)[0] / 2 - 1.96) < 0.15
    days = np.arange(730.0)
    weekly = (1000 + days) * (1 + 0.1 * np.sin(2 * np.pi * days / 7))
    yhat, _, _ = m.trend_forecast(days[:700], weekly[:700], days[700:], np.empty(0))
    assert np.abs(yhat / weekly[700:] - 1).max() < 0.01


def autocovariances(ar, ma, n):
    """By the impulse response, far enough."""
    psi = np.zeros(4000)
    psi[0] = 1
    for k in range(1, len(psi)):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0) + sum(ar[i] * psi[k - 1 - i] for i in range(min(len(ar), k)))
    return np.array([psi[: len(psi) - lag] @ psi[lag:] for lag in range(n)])


def dense(w, ar, ma, h):
    """Variance, log-likelihood, forecasts and their deviations from the joint normal distribution of all values."""
    n, g = len(w), autocovariances(ar, ma, len(w) + h)
    cov = lambda a, b: g[np.abs(np.subtract.outer(a, b))]
    past, ahead = np.arange(n), np.arange(n, n + h)
    variance = w @ np.linalg.solve(cov(past, past), w) / n
    loglik = -0.5 * (n * np.log(2 * np.pi * variance) + n + np.linalg.slogdet(cov(past, past))[1])
    weights = np.linalg.solve(cov(past, past), cov(past, ahead))
    return variance, loglik, weights.T @ w, np.sqrt(variance * np.diag(cov(ahead, ahead) - cov(ahead, past) @ weights))


@pytest.mark.parametrize("ar, ma", [((0.5, 0.2), (0.4, 0.3)), ((0.9,), (-0.95,)), ((), (0.5,)), ((0.3, -0.4), ()), ((0.2,), (0.999,))])
def test_likelihood_is_that_of_the_joint_normal_distribution(ar, ma):
    """Series of different lengths in one batch, shorter and longer than a block."""
    rng = np.random.default_rng(1)
    series_ = [rng.normal(size=n) for n in (30, 57, 200, 31, 3, 4, 5)]
    w, lengths = m.padded(series_)
    a, b = (np.tile(np.array(x), (len(w), 1)).reshape(len(w), -1) for x in (ar, ma))
    found = m.kalman(w, lengths, a, b)
    variance, loglik = m.likelihood(found, lengths)
    center, deviation = m.arima_ahead(found, variance, a, b, [], 0, 5)
    for i, x in enumerate(series_):
        wanted = dense(x, ar, ma, 5)
        for got, want in zip((variance[i], loglik[i], center[i], deviation[i]), wanted):
            assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_arima_is_most_likely_and_its_band_covers():
    """No parameters nearby are more likely, simulated ones are found, and 95 of 100 bands hold the next level."""
    rng = np.random.default_rng(5)
    levels = []
    for _ in range(300):
        e, w = rng.normal(size=420), np.zeros(420)
        for t in range(2, 420):
            w[t] = 0.6 * w[t - 1] - 0.2 * w[t - 2] + e[t] - 0.5 * e[t - 1]
        levels.append(1000 + w[20:].cumsum())
    w, lengths = m.padded([np.diff(y[:390]) for y in levels])
    x = m.fit_arma(w, lengths, 2, 1)
    best = m.likelihood(m.kalman(w, lengths, *m._parameters(x, 2)), lengths)[1]
    for _ in range(6):
        near = m.likelihood(m.kalman(w, lengths, *m._parameters(x + rng.normal(0, 0.05, x.shape), 2)), lengths)[1]
        assert (near <= best + 1e-6).all()
    ar, ma = m._parameters(x, 2)
    assert np.allclose(np.median(ar, axis=0), [0.6, -0.2], atol=0.12) and abs(np.median(ma) + 0.5) < 0.12
    answers = m.arima_forecasts([y[:390] for y in levels], 5, (2, 1, 1))
    inside = [[low[k] <= y[390 + k] <= high[k] for k in range(5)] for y, (_, low, high) in zip(levels, answers)]
    assert 0.92 <= np.mean(inside) <= 0.975


def test_sampled_band_of_the_trend_covers_and_repeats():
    rng, inside = np.random.default_rng(7), []
    days = np.arange(400.0)
    for i in range(120):
        slope = np.cumsum(rng.laplace(0, 0.02, 420) * (rng.random(420) < 0.06))
        y = 500 + slope.cumsum()[:420] + rng.normal(0, 5, 420)
        ahead = np.arange(400.0, 407.0)
        _, low, high = m.trend_forecast(days, y[:400], ahead, [], seed=i)
        inside.append(((low <= y[400:407]) & (y[400:407] <= high)).mean())
    assert 0.75 <= np.mean(inside) <= 0.85
    one, same, other = (m.trend_forecast(days, y[:400], ahead, [], seed=s) for s in (1, 1, 2))
    assert all((a == b).all() for a, b in zip(one, same)) and not (one[1] == other[1]).all()


def test_grid_in_numpy_is_the_operators(spark):
    rng = np.random.default_rng(3)
    start = np.datetime64("2023-01-01")
    for _ in range(4):
        days = np.sort(rng.choice(60, 25, replace=False)) + start
        rows = [("a", d, None if rng.random() < 0.1 else float(i)) for i, d in enumerate(days.astype(object))]
        want = sorted((r.ds, r.y) for r in panel.to_business_days(spark.createDataFrame(rows, FX)).collect())
        grid, y = m.business_days(days, np.array([np.nan if r[2] is None else r[2] for r in rows]))
        assert list(zip(grid.astype(object), y)) == want


@pytest.mark.parametrize("model", [fc.baseline_model("last"), fc.baseline_model("drift"), fc.arima_model((1, 1, 0)), fc.trend_model(samples=50)])
def test_folds_in_one_pass_are_those_of_refits(spark, model):
    fx = series(spark, 83, lambda i: 100 + 5 * np.sin(i) + i * 0.3, name="a").unionByName(series(spark, 31, lambda i: 10 + (i * 7) % 5, name="b")).unionByName(series(spark, 3, name="c"))
    keys = ("series_id", "fold")
    told = lambda df: {(r.series_id, r.fold, r.step, r.ds, r.error): (r.yhat, r.yhat_lower, r.yhat_upper) for r in df.collect()}
    once, again = told(model.folds(fx, 4, 3)), told(model(fc.walk_forward_folds(fx, 4, 3).where("part = 'train'"), 4, keys))
    assert once.keys() == again.keys() and len(once) > 20
    for k, x in once.items():
        assert x == again[k] or x == pytest.approx(again[k], rel=1e-6)


def test_test_rows_of_folds(spark):
    fx = series(spark, 37)
    for h, k in ((3, 4), (20, 4), (7, 1), (1, 40)):
        want = sorted((r.fold, r.ds) for r in fc.walk_forward_folds(fx, h, k).where("part = 'test'").collect())
        assert sorted((r.fold, r.ds) for r in fc.fold_tests(fx, h, k).collect()) == want


def test_small_batches_of_series(spark):
    """Series that go on over Arrow batches and null keys are kept apart."""
    rows = [(None if s == 3 else f"s{s}", date(2023, 1, 2) + timedelta(days=i), float((i * (s + 3)) % 13)) for s in range(9) for i in range(40)]
    fx = spark.createDataFrame(rows, FX)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = fc.arima_model((1, 1, 0))(fx, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.series_id or "", r.step) for r in got) == sorted((s or "", i) for s in {r[0] for r in rows} for i in (1, 2))


def test_holidays_follow_their_rules():
    assert [easter(y) for y in (2000, 2008, 2019, 2024, 2025, 2038)] == [date(2000, 4, 23), date(2008, 3, 23), date(2019, 4, 21), date(2024, 3, 31), date(2025, 4, 20), date(2038, 4, 25)]
    of = colombian(2024)
    assert len(of) == 18 and of["Epiphany"] == date(2024, 1, 8) and of["Saint Joseph"] == date(2024, 3, 25) and of["Cartagena"] == date(2024, 11, 11)
    assert (of["Good Friday"], of["Ascension"], of["Corpus Christi"], of["Sacred Heart"]) == (date(2024, 3, 29), date(2024, 5, 13), date(2024, 6, 3), date(2024, 6, 10))


def test_each_holiday_has_its_own_effect(spark):
    """Two holidays with opposite effects; their days of the last year are forecast."""
    off = lambda year: {"up": date(year, 3, 12), "down": date(year, 3, 14)}
    days = [d for d in business_days(1100, "2020-01-01") if d < date(2024, 3, 12)]
    y = {d: 4000 + 400 * (d == off(d.year)["up"]) - 400 * (d == off(d.year)["down"]) for d in days}
    fx = spark.createDataFrame([("a", d, float(y[d])) for d in days], FX)
    got = {r.ds: r.yhat for r in fc.trend_model(holidays=off)(fx, 5).collect()}
    plain = {r.ds: r.yhat for r in fc.trend_model(holidays=None)(fx, 5).collect()}
    assert got[date(2024, 3, 12)] > 4200 and got[date(2024, 3, 14)] < 3800
    assert abs(plain[date(2024, 3, 12)] - 4000) < 200


def test_accuracy(spark):
    fx = series(spark, 10)
    rows = [("a", "m", 0, i + 1, r.ds, r.y, r.y, r.y) for i, r in enumerate(fx.collect()[-5:])] + [("a", "late", 0, 1, date(2030, 1, 1), 1.0, 1.0, 1.0)]
    forecasts = spark.createDataFrame(rows, "series_id string, model_name string, model_rank int, step int, ds date, yhat double, yhat_lower double, yhat_upper double")
    metrics, errors = fc.evaluate(forecasts, fx)
    r = metrics.first()
    assert (r.mae, r.rmse, r.mape, r.n_samples) == (0, 0, 0, 5) and [e.message for e in errors.collect()] == ["late: no date in common"]


@settings(max_examples=8, deadline=None)
@given(n=st.integers(1, 40), h=st.integers(1, 9), k=st.integers(1, 5))
def test_folds_never_leak(spark, n, h, k):
    rows = fc.walk_forward_folds(series(spark, n), h, k).collect()
    size = n // (k + 1)
    assert {r.fold for r in rows} == ({i for i in range(1, k + 1) if size * i < n} if size else set())
    for fold in {r.fold for r in rows}:
        train, test = ([r.ds for r in rows if r.fold == fold and r.part == p] for p in ("train", "test"))
        assert len(train) == size * fold and len(test) == min(h, n - size * fold) and max(train) < min(test)


def test_a_series_alone_gives_what_it_gives_among_others(spark):
    fx = series(spark, 60, name="a")
    more = fx.unionByName(series(spark, 45, lambda i: 10 - i, name="b"))
    alone = {r.step: r.yhat for r in fc.arima_model()(series(spark, 60, lambda i: 100 + (i * 7) % 13, name="a"), 4, fc.KEYS).collect()}
    among = fc.arima_model()(series(spark, 60, lambda i: 100 + (i * 7) % 13, name="a").unionByName(more.where("series_id = 'b'")), 4, fc.KEYS)
    assert {r.step: r.yhat for r in among.where("series_id = 'a'").collect()} == pytest.approx(alone, rel=1e-6)


# -- the daily run


def test_daily_run(spark):
    fx = series(spark, 250, lambda i: 4000 + np.random.default_rng(i).normal(0, 30), name="COP/USD")
    articles = article(spark, [("u1", "deficit", "trade", RUN, 0, 0), ("u2", "oil falls", "oil", RUN, 0, 1)])
    reply = '[{"index": 0, "topic": "trade", "severity": "medium"}]\n---\nA calm outlook.'
    run = run_daily(fx, articles, date(2023, 12, 15), 3, model_reply=lambda texts: [reply for _ in texts])
    report_row = run.reports.first()
    assert "## 3-Day Forecast" in report_row.report and "A calm outlook." in report_row.report and "TREND" in report_row.report
    assert run.ensemble.count() == 3 and run.errors.count() == 0
    post = run.outbox.first()
    assert post.status == "dry-run" and len(post.post) <= 280
    assert {r.title: r.topic for r in run.analyzed.collect()} == {"deficit": "trade", "oil falls": "other"}
    run.close()

    def fails(texts):
        raise RuntimeError("down")

    run = run_daily(fx, articles, date(2023, 12, 15), 3, model_reply=fails)
    assert run.ensemble.count() == 3 and news.NO_ANALYSIS in run.reports.first().report
    assert {r.severity for r in run.analyzed.collect()} == {"low", "high"}
    assert [(r.series_id, r.stage) for r in run.errors.collect()] == [("2023-12-15", "news")]
    run.close()


def test_a_reply_is_asked_for_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def reply(texts):
        with open(asked, "a") as f:
            f.write("x")
        return ["[]\n---\nCalm." for _ in texts]

    run = run_daily(series(spark, 60), article(spark, [("u1", "deficit", "trade", RUN, 0, 0)]), date(2023, 3, 20), 3, {"last": fc.baseline_model()}, model_reply=reply)
    assert "Calm." in run.reports.first().report
    run.close()  # what was only kept is gone, as with a lost executor
    assert run.analyzed.count() == 1 and run.errors.count() == 0 and "Calm." in run.reports.first().report
    assert open(asked).read() == "x"


def test_replies_are_known_by_model_and_text(spark, tmp_path):
    asked, path = tmp_path / "asked", str(tmp_path / "ledger")
    digests = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one"), ("d", None)], "batch string, digest string")

    def reply(texts):
        with open(asked, "a") as f:
            f.write(f"{texts[0]}\n")
        if texts[0] == "two":
            raise RuntimeError("down")
        return [f"re {texts[0]}"]

    told = lambda df: {r.batch: r.raw for r in df.collect()}
    assert told(ledger.ask(digests.where("batch <> 'd'"), "m", reply, path, attempts=2)) == {"a": "re one", "b": None, "c": "re one"}
    assert sorted(asked.read_text().split()) == ["one", "two", "two"]
    assert told(ledger.ask(digests.where("batch = 'a'"), "m", reply, path)) == {"a": "re one"} and asked.read_text().count("one") == 1
    ledger.ask(digests.where("batch = 'a'"), "other", reply, path)
    assert asked.read_text().count("one") == 2
    assert {(r.model, r.attempts) for r in ledger.read_replies(spark, path).collect()} == {("m", 1), ("m", 2), ("other", 1)}
    assert told(ledger.ask(digests.where("batch = 'x'"), "m", reply, path)) == {}


def test_posts_go_out_once(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts = lambda **texts: spark.createDataFrame([(k, "2024-06-01", v) for k, v in texts.items()], "series_id string, run_date string, post string")
    state = lambda: {r.series_id: (r.version, r.status, r.post) for r in ledger.read_posts(spark, path).collect()}
    assert {r.series_id for r in ledger.hand_out(posts(a="x", b="y", c="", d="z" * 281), path, False).collect()} == {"a", "b"}
    ledger.hand_out(posts(a="x", b="y"), path, True)
    assert state() == {"a": (2, "ready", "x"), "b": (2, "ready", "y")}
    ledger.hand_out(posts(a="x", b="y"), path, True)
    ledger.mark(posts(a="", e="").withColumn("status", F.lit("sent")), path)
    ledger.mark(posts(a="").withColumn("status", F.lit("nonsense")), path)
    ledger.hand_out(posts(a="changed", b="changed"), path, True)
    assert state() == {"a": (3, "sent", "x"), "b": (3, "ready", "changed")}


def test_a_date_that_is_run_again_asks_and_posts_once(spark, tmp_path):
    asked = tmp_path / "asked"

    def reply(texts):
        with open(asked, "a") as f:
            f.write("x")
        return ["[]\n---\nCalm." for _ in texts]

    pairs = spark.createDataFrame([("a", "EUR", "BRL", "#Real")], "series_id string, base string, quote string, tags string")
    cached = lambda: spark._jsparkSession.sharedState().cacheManager().isEmpty()
    spark.catalog.clearCache()  # what other tests left
    for _ in range(2):
        run = run_daily(series(spark, 60), article(spark, [("u1", "deficit", "trade", RUN, 0, 0)]), date(2023, 3, 20), 3, {"last": fc.baseline_model()}, model_reply=reply, pairs=pairs, publish=True, replies_path=str(tmp_path / "replies"), posts_path=str(tmp_path / "posts"))
        row = run.reports.first()
        assert row.report.startswith("# BRL/EUR Intelligence") and "Calm." in row.report
        (post,) = run.outbox.collect()
        assert post.status == "ready" and post.version == 1 and post.post.endswith("#Real") and run.errors.count() == 0
        run.close()
        assert cached()  # every frame that was kept is freed
    assert asked.read_text() == "x"


def test_narratives_are_folded(spark):
    rows = spark.createDataFrame([("b", "two"), ("a", "one"), ("c", news.NO_ANALYSIS)], "batch string, narrative string")
    assert news.fold_narratives(rows, "d").collect() == [("d", "one\ntwo")]
    assert news.fold_narratives(rows.where("batch = 'c'"), "d").first().narrative == news.NO_ANALYSIS
    assert news.fold_narratives(rows.where("batch = 'x'"), "d").count() == 0


def test_daily_run_from_landed_files(spark, tmp_path):
    import json

    (tmp_path / "rates").mkdir()
    days = {str(d): {"4. close": str(4000 + i)} for i, d in enumerate(business_days(60))}
    (tmp_path / "rates" / "good.json").write_text(json.dumps({"Time Series FX (Daily)": days}))
    (tmp_path / "rates" / "limit.json").write_text('{"Note": "too many calls"}')
    (tmp_path / "feed.xml").write_text("<rss><channel><title>Feed</title><item><title>oil</title><link>u1</link></item></channel></rss>")
    (tmp_path / "answer.json").write_text('{"articles":[{"title":"t","url":"u2"},{"title":"again","url":"u1"}]}')
    (tmp_path / "broken.json").write_text("{{{")
    models = {"last": fc.baseline_model()}
    at = lambda *names: [str(tmp_path / n) for n in names]
    run = run_landed(spark, str(tmp_path / "rates"), date(2023, 3, 25), at("feed.xml"), at("answer.json", "broken.json"), series(spark, 60, name="limit"), models=models)
    assert {r.series_id for r in run.reports.collect()} == {"good", "limit"}
    assert {(r.title, r.severity) for r in run.analyzed.collect()} == {("oil", "high"), ("t", "low")}
    assert sorted((r.stage, r.message) for r in run.errors.collect()) == [("news", "unreadable file"), ("rates", "too many calls")]
    run.close()
    (tmp_path / "limit.csv").write_text("fecha;valor\n" + "".join(f"{d:%d/%m/%Y};3950,25\n" for d in business_days(50)))
    (tmp_path / "page.html").write_text("<table>" + "".join(f"<tr><td>{d:%d/%m/%Y}</td><td>12,5</td></tr>" for d in business_days(50)) + "</table>")
    (tmp_path / "none.html").write_text("<p>down for today")
    run = run_landed(spark, str(tmp_path / "rates"), date(2023, 3, 25), tables={"limit": str(tmp_path / "limit.csv"), "good": str(tmp_path / "limit.csv")}, pages={"page": str(tmp_path / "page.html"), "none": str(tmp_path / "none.html")}, models=models)
    assert {r.series_id: r.latest_rate for r in run.summary.collect()} == {"good": 4059.0, "limit": 3950.25, "page": 12.5}
    assert sorted((r.series_id, r.stage, r.message.split(":")[0]) for r in run.errors.collect()) == [("limit", "rates", "too many calls"), ("none", "rates", "no table rows")]
    run.close()
    bare = run_landed(spark, str(tmp_path / "rates"), date(2023, 3, 25), models=models)
    assert bare.analyzed.count() == 0 and news.NO_NEWS in bare.reports.first().report
    bare.close()


def test_report_texts(spark):
    summary = spark.createDataFrame([("a", 4050.0, 1.25)], "series_id string, latest_rate double, rate_change_pct double")
    told = spark.createDataFrame([("2024-06-01", "Steady.")], "run_date string, narrative string")
    nothing = spark.createDataFrame([], "series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double")
    metrics = spark.createDataFrame([], "series_id string, model_name string, mae double, rmse double, mape double, n_samples long")
    row = report.build_reports(summary, told, nothing, metrics, "2024-06-01", 3).first()
    assert "1 USD = 4,050.00 COP" in row.report and "+1.25%" in row.report and row.report.rstrip().endswith("N/A") and report.UP in row.report


def test_digest_and_listing_are_newest_first(spark):
    """Fifty articles that come in out of order: the digest has the twenty newest, from the newest on."""
    import random
    from datetime import datetime, timedelta

    from ratewatch.operators import news, report

    order = list(range(50))
    random.Random(2).shuffle(order)
    rows = [(f"t{k}", "s", f"u{k}", "feed", datetime(2024, 1, 1) + timedelta(hours=k), 0, i, "day") for i, k in enumerate(order)]
    articles = spark.createDataFrame(rows, "title string, summary string, url string, source string, published_at timestamp, feed_rank int, entry_seq long, batch string")
    lines = news.build_digest(articles, "batch", "narrative").first().digest.split("\n")
    assert lines == [f"[{i + 1}] t{49 - i} — s" for i in range(20)]
    shown = report.article_view(news.classify_keywords(articles)).collect()
    assert [r.line.split("| ")[1] for r in shown] == [f"t{49 - i}" for i in range(10)]


def test_digests_hand_on_few_short_rows(spark):
    """Before the shuffle each task keeps as many articles of a batch as the digest has, and no whole summary."""
    from ratewatch.plans import tables

    digests = news.build_digest(tables.articles(spark, "/root/testdata/sf0.01"), "source", "narrative")
    plan = digests._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
    at_window = next(line for line in plan.splitlines() if "WindowGroupLimit" in line)
    assert "summary" not in at_window
