"""One query for each operator over the shared tables, and the SQL that says what it has to return."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ratewatch.operators import forecast as fc
from ratewatch.operators import news, panel, report
from ratewatch.plans import landed
from ratewatch.plans import tables as t
from ratewatch.plans.registry import QUERIES, SQL, Query, query
from ratewatch.sources import ledger, store
from ratewatch.sources.rates import with_fallback
from ratewatch.sources.sinks import post_outbox

AS_OF, HORIZON = date(2001, 8, 1), 7
KEYWORDS = [*news.KEYWORDS, "license"]


def _r(places: int, *names: str):
    return {n: F.round(n, places) for n in names}


# -- rates


@query(t.with_tables("SELECT series_id, ds, round(y, 4) AS y FROM orders_panel WHERE ds BETWEEN DATE '2001-08-01' - 365 AND DATE '2001-08-01'", "orders_panel"))
def fx_lookback(spark, sf_dir):
    return panel.lookback(t.orders_panel(spark, sf_dir), AS_OF).withColumns(_r(4, "y"))


_SUMMARY = """SELECT series_id, max(ds) AS latest_ds, max(CASE WHEN rn = 1 THEN y END) AS latest_rate,
coalesce(max(CASE WHEN rn = 30 THEN y END), max(CASE WHEN rn = n THEN y END)) AS reference_rate, max(n) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM {panel}) GROUP BY 1"""


@query(
    t.with_tables(
        f"SELECT series_id, latest_ds, round(latest_rate, 4) AS latest_rate, round(reference_rate, 4) AS reference_rate, n, round((latest_rate - reference_rate) / reference_rate * 100, 2) AS rate_change_pct FROM ({_SUMMARY.format(panel='(SELECT * FROM events_panel UNION ALL SELECT * FROM orders_panel)')})",
        "events_panel",
        "orders_panel",
    )
)
def fx_summary(spark, sf_dir):
    fx = t.events_panel(spark, sf_dir).unionByName(t.orders_panel(spark, sf_dir))
    return panel.fx_summary(fx).withColumns(_r(4, "latest_rate", "reference_rate"))


@query(
    t.with_tables(
        """SELECT series_id, ds, round(y, 4) AS y FROM (
  SELECT g.series_id, g.ds, last_value(p.y IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ds) AS y FROM
  (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM orders_panel GROUP BY 1) g
  LEFT JOIN orders_panel p ON g.series_id = p.series_id AND g.ds = p.ds WHERE isodow(g.ds) < 6) WHERE y IS NOT NULL""",
        "orders_panel",
    )
)
def fx_business_days(spark, sf_dir):
    return panel.to_business_days(t.orders_panel(spark, sf_dir)).withColumns(_r(4, "y"))


_FUTURE = """SELECT series_id, CAST(step AS INTEGER) AS step, ds FROM (
  SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS step FROM
  (SELECT series_id, CAST(unnest(generate_series(max(ds) + INTERVAL 1 DAY, max(ds) + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM {panel} GROUP BY 1) WHERE isodow(ds) < 6) WHERE step <= 7"""


@query(t.with_tables(_FUTURE.format(panel="orders_panel"), "orders_panel"))
def fx_future_days(spark, sf_dir):
    return panel.future_business_days(t.orders_panel(spark, sf_dir), HORIZON)


@query(
    t.with_tables(
        "SELECT series_id, ds, round(y, 4) AS y, CASE WHEN rn <= 30 THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM orders_panel)",
        "orders_panel",
    )
)
def fx_holdout(spark, sf_dir):
    train, test = panel.holdout_split(t.orders_panel(spark, sf_dir), 30)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).withColumns(_r(4, "y"))


_RECENT = "(SELECT * FROM orders_panel WHERE ds BETWEEN DATE '2001-08-01' - 365 AND DATE '2001-08-01')"


@query(
    t.with_tables(
        f"SELECT series_id, latest_ds, round(latest_rate, 4) AS latest_rate, round(reference_rate, 4) AS reference_rate, n, round((latest_rate - reference_rate) / reference_rate * 100, 2) AS rate_change_pct, (SELECT count(*) FROM orders_panel) AS stored FROM ({_SUMMARY.format(panel=_RECENT)})",
        "orders_panel",
    )
)
def fx_store(spark, sf_dir):
    """The panel stored by month and series, the look-back read from it, and the rows that were counted while it was written."""
    name = f"panel_{uuid.uuid4().hex}"
    seen = store.write_panel(t.orders_panel(spark, sf_dir), name, landed.path_of(spark, "panel"), buckets=8)
    recent = store.read_panel(spark, name, AS_OF)
    return panel.fx_summary(recent).withColumns(_r(4, "latest_rate", "reference_rate")).withColumn("stored", F.lit(seen["n"]).cast("long"))


@query(t.with_tables("SELECT series_id, count(*) AS n, min(ds) AS first, max(ds) AS last FROM lineitem_panel GROUP BY 1", "lineitem_panel"))
def fx_ingest_counts(spark, sf_dir):
    return panel.ingest_counts(t.lineitem_panel(spark, sf_dir))


@query(
    t.with_tables(
        "SELECT series_id, ds, round(CASE WHEN series_id = (SELECT max(event_type) FROM events) THEN -y ELSE y END, 4) AS y FROM events_panel",
        "events_panel",
    )
)
def fx_fallback(spark, sf_dir):
    """The fallback has every series (with the sign turned, to be seen), the primary source all but one."""
    every = t.events_panel(spark, sf_dir)
    missing = t.table(spark, sf_dir, "events").agg(F.max("event_type").alias("missing"))
    primary = every.join(F.broadcast(missing), F.col("series_id") == F.col("missing"), "left_anti")
    return with_fallback(primary, every.withColumn("y", -F.col("y"))).withColumns(_r(4, "y"))


# -- news


@query(
    "SELECT feed_rank, count(*) AS n, count(DISTINCT url) AS urls, sum(chars) AS chars FROM (SELECT CAST(substring(source, 4) AS INTEGER) AS feed_rank, md5(text) AS url, length(text) AS chars FROM documents UNION ALL SELECT 1000, url, length(html) FROM pages) GROUP BY 1"
)
def news_union(spark, sf_dir):
    both = news.union_feeds(t.articles(spark, sf_dir), t.page_articles(spark, sf_dir))
    return both.groupBy("feed_rank").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.sum(F.length("summary")).alias("chars"))


@query(
    t.with_tables(
        "SELECT url, title, feed_rank, entry_seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed_rank, entry_seq) AS rn FROM articles) WHERE rn = 1",
        "articles",
    )
)
def news_dedup(spark, sf_dir):
    return news.dedup_by_url(t.articles(spark, sf_dir).drop("summary")).select("url", "title", "feed_rank", "entry_seq")


_WHEN = "strftime(published_at, '%Y-%m-%d %H:%M') AS published"


@query(t.with_tables(f"SELECT entry_seq, title, {_WHEN} FROM articles ORDER BY published_at DESC, feed_rank, entry_seq LIMIT 50", "articles"))
def news_latest(spark, sf_dir):
    return news.latest_articles(t.articles(spark, sf_dir)).select("entry_seq", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


@query(
    t.with_tables(
        f"SELECT source, CAST(rank AS INTEGER) AS rank, entry_seq, title, {_WHEN} FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, feed_rank, entry_seq) AS rank FROM articles) WHERE rank <= 5",
        "articles",
    )
)
def news_latest_per_source(spark, sf_dir):
    return news.latest_articles(t.articles(spark, sf_dir), 5, by="source").select("source", "rank", "entry_seq", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


_HIT = " OR ".join(f"contains(lower(title || ' ' || summary), '{k}')" for k in KEYWORDS)
_FALLBACK = f"'other' AS topic, CASE WHEN {_HIT} THEN 'high' ELSE 'low' END AS severity, false AS bullish_cop, '{news.FALLBACK_REASON}' AS reasoning"
_LABELS = ["entry_seq", "topic", "severity", "bullish_cop", "reasoning"]


@query(t.with_tables(f"SELECT entry_seq, {_FALLBACK} FROM articles", "articles"))
def news_keywords(spark, sf_dir):
    return news.classify_keywords(t.articles(spark, sf_dir), KEYWORDS).select(*_LABELS)


@query(
    t.with_tables(
        "SELECT source AS batch, string_agg('[' || (index + 1) || '] ' || title || ' — ' || substring(summary, 1, 200), chr(10) ORDER BY index) AS digest FROM numbered WHERE index < 20 GROUP BY 1",
        "articles",
        "numbered",
    )
)
def news_digest(spark, sf_dir):
    return news.build_digest(t.articles(spark, sf_dir), "source", "narrative")


def _stub(digests: list[str]) -> list[str]:
    """In a model's place: fails for some digests."""
    if len(digests[0]) % 5 == 0:
        raise ValueError("no reply")
    return [f"read {len(d)}" for d in digests]


@query(f"SELECT batch, CASE WHEN length(digest) % 5 <> 0 THEN 'read ' || length(digest) END AS raw FROM ({SQL['news_digest']})")
def news_model_calls(spark, sf_dir):
    """A stub replies to each source's digest; where it fails, that reply alone is null."""
    return news.call_model(news.build_digest(t.articles(spark, sf_dir), "source", "narrative"), _stub)


_BAD = "feed_rank % 5 = 4"


@query(
    t.with_tables(
        f"""SELECT source AS batch, CASE WHEN {_BAD} THEN NULL ELSE count(doc_id) END AS n_items, CASE WHEN {_BAD} THEN NULL ELSE sum(CASE WHEN doc_id IS NULL THEN 0 ELSE index END) END AS sum_index,
CASE WHEN {_BAD} THEN '{news.NO_ANALYSIS}' ELSE 'outlook of ' || source END AS narrative FROM numbered LEFT JOIN labels ON entry_seq = doc_id GROUP BY source, feed_rank""",
        "articles",
        "numbered",
    )
)
def news_reply_parse(spark, sf_dir):
    parsed = news.parse_reply(t.replies(spark, sf_dir))
    return parsed.select("batch", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["index"]).alias("sum_index"), "narrative")


_ATTACHED = "CASE WHEN doc_id IS NULL THEN 'other' ELSE 'macro' END AS topic, CASE WHEN doc_id IS NULL THEN 'low' WHEN toxic = 1 THEN 'high' ELSE 'medium' END AS severity, coalesce(quality = 1, false) AS bullish_cop, CASE WHEN doc_id IS NULL THEN '' ELSE 'label of ' || doc_id END AS reasoning"


@query(t.with_tables(f"SELECT entry_seq, {_ATTACHED} FROM numbered LEFT JOIN labels ON entry_seq = doc_id WHERE NOT ({_BAD}) UNION ALL SELECT entry_seq, {_FALLBACK} FROM numbered WHERE {_BAD}", "articles", "numbered"))
def news_classify(spark, sf_dir):
    articles = t.articles(spark, sf_dir).withColumn("batch", F.col("source"))
    return news.classify(articles, t.replies(spark, sf_dir, narrative=False), keywords=KEYWORDS).select(*_LABELS)


@query(t.with_tables(f"SELECT entry_seq, CASE WHEN {_BAD} THEN 'other' ELSE topic END AS topic, CASE WHEN {_BAD} THEN 'low' ELSE severity END AS severity, NOT ({_BAD}) AND bullish_cop AS bullish_cop, CASE WHEN {_BAD} THEN '' ELSE reasoning END AS reasoning FROM (SELECT entry_seq, feed_rank, {_ATTACHED} FROM numbered LEFT JOIN labels ON entry_seq = doc_id)", "articles", "numbered"))
def news_attach(spark, sf_dir):
    numbered = news.number_articles(t.articles(spark, sf_dir).withColumn("batch", F.col("source")).drop("summary"), "batch")
    items, _ = news.reply_items(t.replies(spark, sf_dir, narrative=False))
    return news.attach_labels(numbered, items).select(*_LABELS)


@query(
    t.with_tables(
        f"""SELECT run, CASE WHEN src IS NULL THEN '{news.NO_NEWS}' WHEN {_BAD} THEN '{news.NO_ANALYSIS}' ELSE 'outlook of ' || src END AS narrative
FROM (SELECT DISTINCT source AS run FROM articles UNION ALL SELECT DISTINCT l_returnflag FROM lineitem) LEFT JOIN (SELECT DISTINCT source AS src, feed_rank FROM articles) ON run = src""",
        "articles",
    )
)
def news_narrative(spark, sf_dir):
    runs = t.articles(spark, sf_dir).select(F.col("source").alias("run")).distinct().unionByName(t.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run")).distinct())
    narratives = news.parse_reply(t.replies(spark, sf_dir)).select(F.col("batch").alias("run"), "narrative")
    return news.narrative_or_default(runs, narratives, "run")


def _late(digests: list[str]) -> list[str]:
    """In a model's place on the next day."""
    return [f"late {len(d)}" for d in digests]


@query(f"SELECT batch, CASE WHEN length(digest) % 5 <> 0 THEN 'read ' ELSE 'late ' END || length(digest) AS raw, CASE WHEN length(digest) % 5 <> 0 THEN 1 ELSE 2 END AS sent FROM ({SQL['news_digest']})")
def news_reply_ledger(spark, sf_dir):
    """Two runs over the same digests: the second one sends only those that failed in the first."""
    digests = news.build_digest(t.articles(spark, sf_dir), "source", "narrative")
    path = landed.path_of(spark, "reply-ledger")
    ledger.ask(digests, "stub", _stub, path)
    second = ledger.ask(digests, "stub", _late, path)
    sent = ledger.read_replies(spark, path).groupBy("digest_hash").agg(F.count("*").alias("sent"))
    named = digests.select("batch", F.sha2("digest", 256).alias("digest_hash"))
    return second.join(named, "batch").join(sent, "digest_hash").select("batch", "raw", "sent")


@query(
    t.with_tables(
        """SELECT series_id, run_date, CASE WHEN k % 4 = 0 THEN 'sent' ELSE 'ready' END AS status, CASE WHEN k % 4 = 0 THEN 2 WHEN k % 4 = 1 THEN 3 WHEN k % 4 = 2 THEN 2 ELSE 1 END AS version, CASE WHEN k % 4 IN (0, 3) THEN 'post ' ELSE 'new ' END || series_id || ': ' || n AS post
FROM (SELECT series_id, CAST(series_id AS INTEGER) AS k, count(*) AS n FROM nation_panel GROUP BY 1) CROSS JOIN (SELECT '2001-08-01' AS run_date)""",
        "nation_panel",
    )
)
def report_ledger(spark, sf_dir):
    """Posts of a date, handed out, then sent, failed, or left; and handed out again, half of them with a new text."""
    counts = panel.ingest_counts(t.nation_panel(spark, sf_dir)).withColumn("k", F.col("series_id").cast("int") % 4)
    told = lambda word: counts.select("series_id", F.lit("2001-08-01").alias("run_date"), F.concat(word, F.col("series_id"), F.lit(": "), F.col("n").cast("string")).alias("post"), "k")
    path = landed.path_of(spark, "post-ledger")
    ledger.hand_out(told(F.lit("post ")), path, enabled=True)
    ledger.mark(told(F.lit("")).withColumn("status", F.when(F.col("k") == 0, ledger.SENT).when(F.col("k") == 1, ledger.FAILED)), path)
    for _ in range(2):  # the same again changes nothing
        ledger.hand_out(told(F.when(F.col("k") == 3, "post ").otherwise("new ")), path, enabled=True)
    return ledger.read_posts(spark, path)


# -- forecasts


def _baselines() -> dict[str, fc.Model]:
    return {"last": fc.baseline_model("last", rank=0), "drift": fc.baseline_model("drift", rank=1)}


def _models() -> dict[str, fc.Model]:
    return {"trend": fc.trend_model(), "arima": fc.arima_model()}


def _baseline_sql(panel: str, keys: str = "series_id") -> str:
    """Both baselines' forecasts of a panel, by its keys."""
    return f"""SELECT {keys}, model_name, model_rank, CAST(step AS INTEGER) AS step, ds, yhat, yhat - 1.96 * sd AS yhat_lower, yhat + 1.96 * sd AS yhat_upper FROM (
  SELECT *, e + CASE WHEN model_name = 'drift' AND n > 1 THEN (e - s) / (n - 1) ELSE 0 END * step AS yhat FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys}, model_name ORDER BY ds) AS step FROM (
      SELECT {keys}, arg_max(y, ds) AS e, arg_min(y, ds) AS s, count(*) AS n, coalesce(stddev_samp(y), 0) AS sd,
        CAST(unnest(generate_series(max(ds) + INTERVAL 1 DAY, max(ds) + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM {panel} GROUP BY {keys})
      CROSS JOIN (VALUES ('last', 0), ('drift', 1)) v(model_name, model_rank) WHERE isodow(ds) < 6)) WHERE step <= 7"""


def _metrics_sql(forecasts: str, actuals: str, keys: str = "series_id") -> str:
    return f"""SELECT {keys}, model_name, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs((y - yhat) / CASE WHEN y <> 0 THEN y ELSE 1e-9 END)) * 100 AS mape, count(*) AS n_samples
FROM ({forecasts}) JOIN (SELECT {keys}, ds, y FROM {actuals}) USING ({keys}, ds) GROUP BY {keys}, model_name"""


_SPLIT = "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM nation_panel"
_TRAIN, _TEST = f"(SELECT * FROM ({_SPLIT}) WHERE rn > 7)", f"(SELECT * FROM ({_SPLIT}) WHERE rn <= 7)"
_ENSEMBLE = f"SELECT series_id, step, arg_min(ds, model_rank) AS ds, avg(yhat) AS yhat, min(yhat_lower) AS yhat_lower, max(yhat_upper) AS yhat_upper FROM ({_baseline_sql('nation_panel')}) GROUP BY 1, 2"
_BACKTEST = _metrics_sql(_baseline_sql(_TRAIN), _TEST)
_FOLDS = """SELECT series_id, fold, CASE WHEN rn <= size * fold THEN 'train' ELSE 'test' END AS part, ds, y FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY series_id) AS n, count(*) OVER (PARTITION BY series_id) // 5 AS size FROM nation_panel)
  CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS fold) WHERE size > 0 AND n > size * fold AND rn <= size * fold + 7"""
_ROUNDED = "round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 2) AS mape, n_samples"
_METRICS = ["mae", "rmse", "mape"]
_BAND = ["yhat", "yhat_lower", "yhat_upper"]


def _forecasts(spark, sf_dir):
    return fc.forecast_all(t.nation_panel(spark, sf_dir), _baselines(), HORIZON, keep=False)[0]


@query(t.with_tables(f"SELECT series_id, step, ds, round(yhat, 2) AS yhat, round(yhat_lower, 2) AS yhat_lower, round(yhat_upper, 2) AS yhat_upper FROM ({_ENSEMBLE})", "nation_panel"))
def fc_ensemble(spark, sf_dir):
    return fc.ensemble(_forecasts(spark, sf_dir))[0].withColumns(_r(2, *_BAND))


@query(t.with_tables(f"SELECT series_id, model_name, {_ROUNDED} FROM ({_metrics_sql(_baseline_sql('(SELECT * FROM nation_panel WHERE ds <= DATE ' + chr(39) + '2001-01-01' + chr(39) + ')'), 'nation_panel')})", "nation_panel"))
def fc_evaluate(spark, sf_dir):
    fx = t.nation_panel(spark, sf_dir)
    forecasts, _ = fc.forecast_all(fx.where(F.col("ds") <= date(2001, 1, 1)), _baselines(), HORIZON, keep=False)
    return fc.evaluate(forecasts, fx)[0].withColumns(_r(2, *_METRICS))


@query(t.with_tables(f"SELECT series_id, fold, part, ds, round(y, 4) AS y FROM ({_FOLDS})", "nation_panel"))
def fc_folds(spark, sf_dir):
    return fc.walk_forward_folds(t.nation_panel(spark, sf_dir)).withColumns(_r(4, "y"))


@query(
    t.with_tables(
        f"""SELECT series_id, fold, model_name, {_ROUNDED} FROM ({_metrics_sql("SELECT f.* FROM (" + _baseline_sql(f"(SELECT * FROM ({_FOLDS}) WHERE part = 'train')", "series_id, fold") + f") f JOIN (SELECT series_id, fold, count(*) AS m FROM ({_FOLDS}) WHERE part = 'test' GROUP BY 1, 2) c USING (series_id, fold) WHERE step <= m", f"(SELECT * FROM ({_FOLDS}) WHERE part = 'test')", "series_id, fold")}) WHERE model_name = 'drift'""",
        "nation_panel",
    )
)
def fc_walk_forward_baseline(spark, sf_dir):
    return fc.walk_forward_eval(t.nation_panel(spark, sf_dir), fc.baseline_model("drift"), keep=False)[0].withColumns(_r(2, *_METRICS))


@query(t.with_tables(f"SELECT series_id, model_name, {_ROUNDED} FROM ({_BACKTEST})", "nation_panel"))
def fc_backtest_baseline(spark, sf_dir):
    return fc.backtest(t.nation_panel(spark, sf_dir), _baselines(), HORIZON, keep=False)[0].withColumns(_r(2, *_METRICS))


@query()
def fc_trend(spark, sf_dir):
    return fc.trend_model()(t.nation_panel(spark, sf_dir), HORIZON, fc.KEYS)


@query()
def fc_arima(spark, sf_dir):
    return fc.arima_model()(t.nation_panel(spark, sf_dir), HORIZON, fc.KEYS)


_THETAS = [x / 10 for x in range(-9, 10)]
#: Exact innovations of a moving average of first differences: their variance in units of the noise's begins at 1 + theta^2.
_PROFILE = """SELECT series_id, theta, round(sqrt(s / n), 4) AS sigma, round(-0.5 * (n * (ln(2 * pi() * s / n) + 1) + logs), 4) AS loglik,
  round(y + theta * v / f, 4) AS yhat, round(1.959963984540054 * sqrt(s / n * (1 + theta * theta - theta * theta / f + 6 * (1 + theta) * (1 + theta))), 4) AS half FROM run WHERE rn = last"""


@query(
    t.with_tables(
        _PROFILE,
        "orders_panel",
        more=f"""grid AS (SELECT series_id, ds, y FROM (SELECT g.series_id, g.ds, last_value(p.y IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ds) AS y FROM
  (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM orders_panel GROUP BY 1) g
  LEFT JOIN orders_panel p ON g.series_id = p.series_id AND g.ds = p.ds WHERE isodow(g.ds) < 6) WHERE y IS NOT NULL),
steps AS MATERIALIZED (SELECT series_id, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY series_id) - 1 AS last, y, y - lag(y) OVER w AS w FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
run AS (
  SELECT series_id, theta, rn, last, y, w AS v, 1 + theta * theta AS f, w * w / (1 + theta * theta) AS s, ln(1 + theta * theta) AS logs, 1 AS n
  FROM steps CROSS JOIN (SELECT CAST(unnest({_THETAS}) AS DOUBLE) AS theta) WHERE rn = 1
  UNION ALL
  SELECT series_id, theta, rn, last, y, w - theta * v / f, g, s + (w - theta * v / f) * (w - theta * v / f) / g, logs + ln(g), n + 1
  FROM (SELECT r.series_id, theta, p.rn, p.last, p.y, p.w, v, f, s, logs, n, 1 + theta * theta - theta * theta / f AS g FROM run r JOIN steps p ON p.series_id = r.series_id AND p.rn = r.rn + 1))""",
    )
)
def fc_ma_profile(spark, sf_dir):
    """Exact likelihood of ARIMA(0,1,1) over given parameters, and the level that each forecasts a week ahead, with half its band."""
    return fc.ma_profile(t.orders_panel(spark, sf_dir), _THETAS, HORIZON).withColumns(_r(4, "sigma", "loglik", "yhat", "half"))


@query()
def fc_all(spark, sf_dir):
    return fc.forecast_all(t.nation_panel(spark, sf_dir), _models(), HORIZON, keep=False)[0]


@query(t.with_tables(f"SELECT series_id, model_name, model_rank, step, ds, true AS in_band FROM ({_FUTURE.format(panel='nation_panel')}) CROSS JOIN (VALUES ('trend', 0), ('arima', 1)) v(model_name, model_rank)", "nation_panel"))
def fc_all_days(spark, sf_dir):
    """What holds for both models' forecasts whatever the rates: their days and steps, and a band around the forecast."""
    in_band = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return fc_all(spark, sf_dir).select("series_id", "model_name", "model_rank", "step", "ds", in_band.alias("in_band"))


@query()
def fc_walk_forward(spark, sf_dir):
    return fc.walk_forward_eval(t.nation_panel(spark, sf_dir), fc.arima_model(), keep=False)[0]


@query()
def fc_backtest(spark, sf_dir):
    return fc.backtest(t.nation_panel(spark, sf_dir), _models(), HORIZON, keep=False)[0]


# -- report

_TABLE = f"""SELECT series_id, '| Date | Forecast | 95% CI |' || chr(10) || '|------|----------|--------|' || chr(10) ||
string_agg('| ' || strftime(ds, '%Y-%m-%d') || ' | ' || printf('%.2f', round(yhat, 2)) || ' | ' || printf('%.2f', round(yhat_lower, 2)) || ' – ' || printf('%.2f', round(yhat_upper, 2)) || ' |', chr(10) ORDER BY step) AS forecast_table FROM ({_ENSEMBLE}) GROUP BY 1"""
_LINES = f"""SELECT series_id, string_agg('- **' || upper(model_name) || '**: MAE=' || printf('%.2f', round(mae, 2)) || ', RMSE=' || printf('%.2f', round(rmse, 2)) || ', MAPE=' || printf('%.2f', round(mape, 2)) || '%', chr(10) ORDER BY model_name) AS metrics_section FROM ({_BACKTEST}) GROUP BY 1"""
_CHANGE = f"SELECT series_id, latest_rate, round((latest_rate - reference_rate) / reference_rate * 100, 2) AS change FROM ({_SUMMARY.format(panel='nation_panel')})"
_TOLD = "(SELECT string_agg('outlook of ' || source, chr(10) ORDER BY source) FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS INTEGER) AS feed_rank FROM documents) WHERE feed_rank % 5 <> 4)"
_REPORT = f"""SELECT series_id, '2001-08-01' AS run_date, round(latest_rate, 4) AS latest_rate, change AS rate_change_pct, {_TOLD} AS narrative,
'# COP/USD Intelligence Report — 2001-08-01' || chr(10) || chr(10) || '## Current Rate' || chr(10) || '**1 USD = ' || format('{{:,.2f}}', round(latest_rate, 2)) || ' COP** ' || CASE WHEN change > 0 THEN '{report.UP}' ELSE '{report.DOWN}' END || ' (' || printf('%+.2f', change) || '% vs 30 days ago)' || chr(10) || chr(10) ||
'## Market Narrative' || chr(10) || {_TOLD} || chr(10) || chr(10) || '## 7-Day Forecast' || chr(10) || coalesce(forecast_table, '') || chr(10) || chr(10) || '## Model Performance (back-test)' || chr(10) || coalesce(metrics_section, 'N/A') || chr(10) AS report
FROM ({_CHANGE}) LEFT JOIN ({_TABLE}) USING (series_id) LEFT JOIN ({_LINES}) USING (series_id)"""
_POST = f"substring('COP/USD — ' || run_date || chr(10) || '{report.MONEY} 1 USD = ' || format('{{:,.0f}}', round(latest_rate, 0)) || ' COP (' || printf('%+.1f', round(rate_change_pct, 1)) || '% 30d)' || chr(10) || substring(narrative, 1, 120) || '...' || chr(10) || '{report.TAGS}', 1, 280)"


@query(t.with_tables(_TABLE, "nation_panel"))
def report_table(spark, sf_dir):
    return report.forecast_table(fc.ensemble(_forecasts(spark, sf_dir))[0])


@query(t.with_tables(_LINES, "nation_panel"))
def report_metrics(spark, sf_dir):
    return report.metrics_section(fc.backtest(t.nation_panel(spark, sf_dir), _baselines(), HORIZON, keep=False)[0])


def _reports(spark, sf_dir, pairs=None):
    fx = t.nation_panel(spark, sf_dir)
    told = news.fold_narratives(news.parse_reply(t.replies(spark, sf_dir)), "2001-08-01")
    return report.build_reports(panel.fx_summary(fx), told, fc.ensemble(_forecasts(spark, sf_dir))[0], fc.backtest(fx, _baselines(), HORIZON, keep=False)[0], "2001-08-01", HORIZON, pairs=pairs)


@query(t.with_tables(_REPORT, "nation_panel"))
def report_text(spark, sf_dir):
    return _reports(spark, sf_dir).drop("base", "quote", "tags").withColumns(_r(4, "latest_rate"))


_EURO = "CAST(series_id AS INTEGER) % 3 = 1"
_PAIRED = f"CASE WHEN {_EURO} THEN replace(replace({{text}}, 'COP', 'BRL'), 'USD', 'EUR') ELSE {{text}} END"


@query(
    t.with_tables(
        f"SELECT series_id, {_PAIRED.format(text='report')} AS report, CASE WHEN {_EURO} THEN substring(replace(replace(replace(post, '{report.TAGS}', '#Real'), 'COP', 'BRL'), 'USD', 'EUR'), 1, 280) ELSE post END AS post FROM (SELECT series_id, report, {_POST} AS post FROM ({_REPORT}))",
        "nation_panel",
    )
)
def report_pairs(spark, sf_dir):
    """Every third nation's rates are of another pair, with tags of its own."""
    nations = t.table(spark, sf_dir, "nation").where("n_nationkey % 3 = 1")
    pairs = nations.select(F.col("n_nationkey").cast("string").alias("series_id"), F.lit("EUR").alias("base"), F.lit("BRL").alias("quote"), F.lit("#Real").alias("tags"))
    reports = _reports(spark, sf_dir, pairs)
    return reports.select("series_id", "report").join(report.build_posts(reports).select("series_id", "post"), "series_id")


@query(t.with_tables(f"SELECT series_id, run_date, {_POST} AS post FROM ({_REPORT})", "nation_panel"))
def report_posts(spark, sf_dir):
    return report.build_posts(_reports(spark, sf_dir))


@query(t.with_tables(f"SELECT series_id, run_date, post, 'dry-run' AS status FROM (SELECT series_id, run_date, {_POST} AS post FROM ({_REPORT})) WHERE length(post) BETWEEN 1 AND 280", "nation_panel"))
def report_outbox(spark, sf_dir):
    return post_outbox(report.build_posts(_reports(spark, sf_dir)), enabled=False)[0]


@query(
    t.with_tables(
        f"""SELECT feed_rank, entry_seq, '{report.BAD}' || ' [' || rpad(severity, 6, ' ') || '] ' || rpad(topic, 20, ' ') || ' | ' || substring(title, 1, 70) AS line FROM (SELECT feed_rank, entry_seq, published_at, title, {_FALLBACK} FROM articles) ORDER BY published_at DESC, feed_rank, entry_seq LIMIT 10""",
        "articles",
    )
)
def article_view(spark, sf_dir):
    return report.article_view(news.classify_keywords(t.articles(spark, sf_dir), KEYWORDS))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
