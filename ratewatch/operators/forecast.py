"""Forecasts of every series: models, baselines, ensemble, accuracy, hold-out and rolling-origin tests.

A model is a function (fx, horizon, keys) -> DataFrame with the columns of ``FORECAST`` after the keys; a series that it
can't fit gives one row with an ``error``. The keys say what one series is: ``series_id``, or that and a fold. A model
that has ``folds`` forecasts from all rolling origins of a series in one pass over its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.functions import guarded_ratio
from ratewatch.operators import models as m
from ratewatch.operators.holidays import colombian
from ratewatch.operators.panel import holdout_split

FORECAST = "model_name string, model_rank int, step int, ds date, yhat double, yhat_lower double, yhat_upper double, error string"
KEYS = ("series_id",)
Model = Callable[[DataFrame, int, tuple[str, ...]], DataFrame]
_DAY0 = np.datetime64("1970-01-01")


@dataclass(frozen=True)
class Series:
    """One series (or a fold's part of it) as a model sees it: its key, days in order, and rates (not a number where there is none)."""

    key: tuple
    days: np.ndarray
    y: np.ndarray

    def seed(self) -> int:
        return crc32("\x1f".join(map(str, self.key)).encode())


#: Days ahead, forecasts, lower and upper bounds of a series; or why there are none.
Answer = tuple[np.ndarray, np.ndarray, np.ndarray] | m.CannotFit
#: Rows of one batch of series.
BATCH_ROWS = 100_000


def _batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = BATCH_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole series of a partition that is sorted by its keys, about ``most`` rows at a time, and where each series begins."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, most
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            table = pa.Table.from_batches(held)
            starts = _begins(table, keys)
            if len(starts) > 1:
                end = int(starts[-1])  # the last series may go on
                yield table.slice(0, end), starts[:-1]
                held, size, limit = table.slice(end).to_batches(), size - end, most
            else:
                limit = 2 * size
    if size:
        table = pa.Table.from_batches(held)
        yield table, _begins(table, keys)


def _begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        column = table.column(k)
        x, y = column.slice(1), column.slice(0, max(n - 1, 0))
        null = np.asarray(pc.not_equal(pc.is_null(x), pc.is_null(y)), bool)
        new[1:] |= null | np.asarray(pc.fill_null(pc.not_equal(x, y), False), bool)
    return np.flatnonzero(new)


def fold_ends(n: int, k: int) -> list[tuple[int, int]]:
    """Fold and number of training rows of each fold of a series of n rows that has a test row."""
    size = n // (k + 1)
    return [(i, size * i) for i in range(1, k + 1) if size and n > size * i]


@dataclass(frozen=True)
class ArrayModel:
    """A model in numpy: ``fit`` answers a list of series. Partitions are sorted by series and go through in batches of whole series.

    ``dealt``: rows come from a store that keeps each series in one place, so they are dealt out anew only where they don't.
    """

    name: str
    rank: int
    fit: Callable[[list[Series], int], list[Answer]]
    dealt: bool = False

    def __call__(self, fx: DataFrame, horizon: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
        return self._run(fx, horizon, keys, None)

    def folds(self, fx: DataFrame, horizon: int, k: int) -> DataFrame:
        """Forecasts by series and ``fold`` of rolling origins: each row is dealt out once, and a fold is a prefix of its series."""
        return self._run(fx, horizon, KEYS, k)

    def _run(self, fx: DataFrame, horizon: int, keys: tuple[str, ...], k: int | None) -> DataFrame:
        name, rank, fit = self.name, self.rank, self.fit
        names = [*keys, *(["fold"] if k else []), "model_name", "model_rank", "step", "ds", "yhat", "yhat_lower", "yhat_upper", "error"]

        def ahead(last: np.datetime64) -> np.ndarray:
            days = last + np.arange(1, 2 * horizon + 4)
            return days[np.is_busday(days)][:horizon]

        def run(batches):
            for table, starts in _batches(batches, keys):
                days = np.asarray(table.column("ds").cast(pa.int32()), np.int64).astype("datetime64[D]")
                y = table.column("y").to_numpy()
                heads = list(zip(*(table.column(c).take(pa.array(starts)).to_pylist() for c in keys)))
                parts: list[Series] = []
                of, fold = [], []
                for i, (head, s, e) in enumerate(zip(heads, starts, [*starts[1:], table.num_rows])):
                    for number, size in fold_ends(e - s, k) if k else [(0, e - s)]:
                        parts.append(Series((*head, number) if k else head, days[s : s + size], y[s : s + size].astype(float)))
                        of.append(i)
                        fold.append(number)
                rows = {c: [] for c in ("part", "step", "ds", "yhat", "yhat_lower", "yhat_upper", "error")}
                for i, (part, answer) in enumerate(zip(parts, fit(parts, horizon))):
                    failed = isinstance(answer, m.CannotFit)
                    if not failed and not np.isfinite(np.concatenate(answer)).all():
                        failed, answer = True, m.CannotFit("the forecast is no number")
                    n = 1 if failed else horizon
                    rows["part"] += [i] * n
                    rows["step"] += [None] if failed else range(1, horizon + 1)
                    rows["ds"] += [None] if failed else ahead(part.days[-1]).astype(object).tolist()
                    for c, x in zip(("yhat", "yhat_lower", "yhat_upper"), ([None],) * 3 if failed else answer):
                        rows[c] += list(x)
                    rows["error"] += [str(answer) if failed else None] * n
                if not rows["part"]:
                    continue
                part = np.array(rows["part"])
                begins = pa.array(starts[np.array(of)[part]])
                columns = [table.column(c).take(begins).combine_chunks() for c in keys] + ([pa.array(np.array(fold)[part].astype(np.int32))] if k else [])
                columns += [pa.array([name] * len(part)), pa.array(np.full(len(part), rank, np.int32)), pa.array(rows["step"], pa.int32()), pa.array(rows["ds"], pa.date32()), *(pa.array(rows[c], pa.float64()) for c in ("yhat", "yhat_lower", "yhat_upper")), pa.array(rows["error"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

        # a number of tasks of its own: fits take long and rows are few, so a shuffle's size says nothing about the work
        tasks = int(fx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        schema = ", ".join(f"`{c}` {fx.schema[c].dataType.simpleString()}" for c in keys) + (", fold int" if k else "") + ", " + FORECAST
        rows = fx.select(*keys, "ds", "y")
        if self.dealt:  # a window asks for its series in one place and in order, and Spark sees where they are so already
            rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("ds")))
        else:
            rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "ds")
        return rows.mapInArrow(run, schema)


def trend_model(changepoint_prior: float = 0.05, interval_width: float = 0.8, holidays: Callable[[int], Mapping[str, date]] | None = colombian, name: str = "trend", rank: int = 0, samples: int = 1000, dealt: bool = False) -> Model:
    """Trend, weekly and yearly seasons, and holidays, on the rows as they are, weekends included.

    ``holidays`` gives those of a year by name; each name has an effect of its own. None: no holidays. The band is sampled,
    with a seed that hangs on the series' key alone.
    """

    def free(first: np.datetime64, last: np.datetime64) -> list[np.ndarray]:
        days: dict[str, list[int]] = {}
        for year in range(first.astype(object).year, last.astype(object).year + 1) if holidays else ():
            for name, day in holidays(year).items():
                days.setdefault(name, []).append(int((np.datetime64(day, "D") - _DAY0).astype(int)))
        return [np.array(d) for d in days.values()]

    def one(series: Series, horizon: int) -> Answer:
        known = np.isfinite(series.y)
        days, y = series.days[known], series.y[known]
        if not len(days):
            return m.CannotFit("no rates")
        ahead = series.days[-1] + np.arange(1, 2 * horizon + 4)
        ahead = ahead[np.is_busday(ahead)][:horizon]
        try:
            return m.trend_forecast((days - _DAY0).astype(float), y, (ahead - _DAY0).astype(float), free(days[0], ahead[-1]), changepoint_prior, interval_width, seed=series.seed(), samples=samples)
        except (m.CannotFit, np.linalg.LinAlgError) as e:
            return m.CannotFit(str(e))

    return ArrayModel(name, rank, lambda batch, horizon: [one(s, horizon) for s in batch], dealt)


def arima_model(order: tuple[int, int, int] = (2, 1, 2), alpha: float = 0.05, name: str = "arima", rank: int = 1, dealt: bool = False) -> Model:
    """ARIMA by exact likelihood on the business-day grid; the series of a batch are fit together. A date that stands twice is an error."""

    def fit(batch: list[Series], horizon: int) -> list[Answer]:
        out: list[Answer] = [m.CannotFit("a date stands twice")] * len(batch)
        grids = {i: m.business_days(s.days, s.y)[1] for i, s in enumerate(batch) if (np.diff(s.days).astype(int) > 0).all()}
        for some in _alike([(i, len(y)) for i, y in grids.items()]):
            for i, answer in zip(some, m.arima_forecasts([grids[i] for i in some], horizon, order, alpha=alpha)):
                out[i] = answer
        return out

    return ArrayModel(name, rank, fit, dealt)


def _alike(sizes: list[tuple[int, int]], most: int = BATCH_ROWS) -> Iterator[list[int]]:
    """Groups of series of similar length, whose padded rows stay below ``most`` (one series may be above)."""
    group: list[int] = []
    longest = 0
    for i, n in sorted(sizes, key=lambda x: -x[1]):
        if group and longest * (len(group) + 1) > most:
            yield group
            group = []
        longest = longest if group else n
        group.append(i)
    if group:
        yield group


@dataclass(frozen=True)
class BaselineModel:
    """The last rate, or the line through the first and last one (``drift``), in SQL. The band is 1.96 deviations of the rates."""

    kind: str
    name: str
    rank: int

    def __call__(self, fx: DataFrame, horizon: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
        stats = fx.groupBy(*keys).agg(F.max_by("y", "ds").alias("end"), F.min_by("y", "ds").alias("start"), F.count("*").alias("n"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"), F.max("ds").alias("ds"))
        return self._ahead(stats, horizon, keys)

    def folds(self, fx: DataFrame, horizon: int, k: int) -> DataFrame:
        """From running sums over each series, looked at where a fold's training rows end: no row is copied."""
        series, past = W.partitionBy("series_id"), W.partitionBy("series_id").orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
        at = F.row_number().over(series.orderBy("ds"))
        n = F.count("*").over(series)
        size = F.floor(n / (k + 1)).cast("int")
        rows = fx.select("series_id", "ds", F.col("y").alias("end"), F.first("y").over(past).alias("start"), at.alias("n"), n.alias("all"), size.alias("size"), F.coalesce(F.stddev_samp("y").over(past), F.lit(0.0)).alias("sd"))
        ends = rows.where((F.col("size") > 0) & (F.col("n") % F.col("size") == 0) & (F.col("n") < F.col("all"))).withColumn("fold", F.expr("int(n / size)")).where(F.col("fold") <= k)
        return self._ahead(ends, horizon, ("series_id", "fold"))

    def _ahead(self, stats: DataFrame, horizon: int, keys: tuple[str, ...]) -> DataFrame:
        days = F.slice(F.filter(F.sequence(F.date_add("ds", 1), F.date_add("ds", 2 * horizon + 3)), lambda d: F.weekday(d) < 5), 1, horizon)
        each = stats.select(*keys, "end", "start", "n", "sd", F.posexplode(days).alias("at", "ds"))
        slope = F.coalesce(F.try_divide(F.col("end") - F.col("start"), F.col("n") - 1), F.lit(0.0)) if self.kind == "drift" else F.lit(0.0)
        yhat = F.col("end") + slope * (F.col("at") + 1)
        return each.select(*keys, F.lit(self.name).alias("model_name"), F.lit(self.rank).alias("model_rank"), (F.col("at") + 1).alias("step"), "ds", yhat.alias("yhat"), (yhat - 1.96 * F.col("sd")).alias("yhat_lower"), (yhat + 1.96 * F.col("sd")).alias("yhat_upper"), F.lit(None).cast("string").alias("error"))


def baseline_model(kind: str = "last", name: str | None = None, rank: int = 0) -> Model:
    return BaselineModel(kind, name or kind, rank)


def ma_profile(fx: DataFrame, thetas: Sequence[float], horizon: int = 1) -> DataFrame:
    """``series_id, theta, sigma, loglik, yhat, half`` of ARIMA(0,1,1) for given parameters, on the business-day grid.

    The profile of the exact likelihood over theta, and the forecast of the next days' level with half its 95 % band at the
    last of them. Series with a date twice, or of fewer than three grid days, are left out.
    """
    given = np.array(thetas, float)

    def run(batches):
        for table, starts in _batches(batches, KEYS):
            days, y = np.asarray(table.column("ds").cast(pa.int32()), np.int64).astype("datetime64[D]"), table.column("y").to_numpy().astype(float)
            grids = []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                level = m.business_days(days[s:e], y[s:e])[1] if (np.diff(days[s:e]).astype(int) > 0).all() else np.empty(0)
                grids.append(level)
            for some in _alike([(i, len(x) * len(given)) for i, x in enumerate(grids) if len(x) > 2]):
                w, lengths = m.padded([np.diff(grids[i]) for i in some])
                w, lengths, theta = np.repeat(w, len(given), axis=0), np.repeat(lengths, len(given)), np.tile(given, len(some))
                ar, ma = np.empty((len(w), 0)), theta[:, None]
                found = m.kalman(w, lengths, ar, ma)
                variance, loglik = m.likelihood(found, lengths)
                center, deviation = m.arima_ahead(found, variance, ar, ma, [np.repeat([grids[i][-1] for i in some], len(given))], 1, horizon)
                names = table.column("series_id").take(pa.array(np.repeat(starts[some], len(given)))).combine_chunks()
                columns = [names, *map(pa.array, (theta, np.sqrt(variance), loglik, center[:, -1], m.normal_quantile(0.975) * deviation[:, -1]))]
                yield pa.RecordBatch.from_arrays(columns, ["series_id", "theta", "sigma", "loglik", "yhat", "half"])

    kind = fx.schema["series_id"].dataType.simpleString()
    tasks = int(fx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fx.select("series_id", "ds", "y").repartition(tasks, "series_id").sortWithinPartitions("series_id", "ds").mapInArrow(run, f"series_id {kind}, theta double, sigma double, loglik double, yhat double, half double")


def forecast_all(fx: DataFrame, models: Mapping[str, Model], horizon: int, keys: tuple[str, ...] = KEYS, series: DataFrame | None = None, kept: list[DataFrame] | None = None, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all models that fit, and errors: for each failure, for series that no model fits, and for series without data.

    What the models give is kept, so that each series is fit once for both tables; ``kept`` gets it, to be freed later. Who takes
    one of the tables alone needs no ``keep``.
    """
    if not 1 <= horizon <= 30:
        raise ValueError("the horizon is 1 to 30 days")
    every = reduce(lambda a, b: a.unionByName(b), [model(fx, horizon, keys) for model in models.values()])
    if keep:
        every = every.persist(StorageLevel.MEMORY_AND_DISK)
    if keep and kept is not None:
        kept.append(every)
    good = every.where(F.col("error").isNull()).drop("error")
    failed = every.where(F.col("error").isNotNull())
    stage = F.lit("forecast").alias("stage")
    by_model = failed.select(*keys, stage, F.concat("model_name", F.lit(": "), "error").alias("message"))
    counts = every.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("fits"))
    errors = by_model.unionByName(counts.where("fits = 0").select(*keys, stage, F.lit("all models failed").alias("message")))
    if series is not None:
        errors = errors.unionByName(series.select(*keys).distinct().join(fx.select(*keys).distinct(), list(keys), "left_anti").select(*keys, stage, F.lit("no data").alias("message")))
    return good, errors


def ensemble(forecasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By position: the mean forecast, the lowest and the highest bound, and the first model's dates; errors for models of unequal length."""
    lengths = forecasts.groupBy("series_id", "model_name").agg(F.max("step").alias("steps")).groupBy("series_id").agg(F.min("steps").alias("least"), F.max("steps").alias("most"))
    uneven = lengths.where("least <> most").select("series_id")
    out = forecasts.join(uneven, "series_id", "left_anti").groupBy("series_id", "step").agg(F.min_by("ds", "model_rank").alias("ds"), F.avg("yhat").alias("yhat"), F.min("yhat_lower").alias("yhat_lower"), F.max("yhat_upper").alias("yhat_upper"))
    return out, uneven.select("series_id", F.lit("ensemble").alias("stage"), F.lit("models of unequal length").alias("message"))


def evaluate(forecasts: DataFrame, actuals: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """MAE, RMSE and MAPE where dates of forecasts and rates meet; errors for models without such a date."""
    error = F.col("y") - F.col("yhat")
    by = [*keys, "model_name"]
    metrics = forecasts.join(actuals.select(*keys, "ds", "y"), [*keys, "ds"]).groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (F.avg(F.abs(guarded_ratio(error, F.col("y")))) * 100).alias("mape"), F.count("*").alias("n_samples"))
    lost = forecasts.select(*by).distinct().join(metrics.select(*by), by, "left_anti")
    return metrics, lost.select(*keys, F.lit("evaluate").alias("stage"), F.concat("model_name", F.lit(": no date in common")).alias("message"))


def walk_forward_folds(fx: DataFrame, h: int = 7, k: int = 4) -> DataFrame:
    """``series_id, fold, part, ds, y``: fold i trains on the first i of k + 1 equal parts and tests on the next h rows.

    The last fold may have fewer; folds without a test row are left out.
    """
    series = W.partitionBy("series_id")
    rows = fx.withColumn("rn", F.row_number().over(series.orderBy("ds"))).withColumn("size", F.floor(F.count("*").over(series) / (k + 1)).cast("int"))
    n = F.count("*").over(series)
    folds = rows.withColumn("n", n).where("size > 0").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("n") > F.col("size") * F.col("fold"))
    end = F.col("size") * F.col("fold")
    part = F.when(F.col("rn") <= end, "train").when(F.col("rn") <= end + h, "test")
    return folds.select("series_id", "fold", part.alias("part"), "ds", "y").where(F.col("part").isNotNull())


def fold_tests(fx: DataFrame, h: int = 7, k: int = 4) -> DataFrame:
    """``series_id, fold, ds, y``: the test rows of ``walk_forward_folds`` alone; only they are repeated, where folds overlap."""
    series = W.partitionBy("series_id")
    rows = fx.select("series_id", "ds", "y", F.row_number().over(series.orderBy("ds")).alias("rn"), F.floor(F.count("*").over(series) / (k + 1)).cast("int").alias("size")).where("size > 0")
    first, last = F.greatest(F.lit(1), F.ceil((F.col("rn") - h) / F.col("size"))).cast("int"), F.least(F.lit(k), F.floor((F.col("rn") - 1) / F.col("size"))).cast("int")
    return rows.withColumns({"first": first, "last": last}).where("first <= last").select("series_id", F.explode(F.sequence("first", "last")).alias("fold"), "ds", "y")


def walk_forward_eval(fx: DataFrame, model: Model, h: int = 7, k: int = 4, kept: list[DataFrame] | None = None, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accuracy by fold, and errors (folds that can't be fit, or whose forecast dates meet no rate).

    A model without ``folds`` gets the training rows of each fold. Forecasts are kept, so that each fold is fit once for both
    tables; ``kept`` gets them, to be freed later. ``keep`` as in ``forecast_all``.
    """
    keys = ("series_id", "fold")
    forecasts = model.folds(fx, h, k) if hasattr(model, "folds") else model(walk_forward_folds(fx, h, k).where("part = 'train'"), h, keys)
    every = forecasts.persist(StorageLevel.MEMORY_AND_DISK) if keep else forecasts
    if keep and kept is not None:
        kept.append(every)
    test = fold_tests(fx, h, k)
    sizes = test.groupBy(*keys).agg(F.count("*").alias("rows"))
    good = every.where(F.col("error").isNull()).join(sizes, list(keys)).where(F.col("step") <= F.col("rows"))
    metrics, lost = evaluate(good, test, keys)
    failed = every.where(F.col("error").isNotNull()).select(*keys, F.lit("walk_forward").alias("stage"), F.col("error").alias("message"))
    return metrics, failed.unionByName(lost)


def backtest(fx: DataFrame, models: Mapping[str, Model], horizon: int = 7, kept: list[DataFrame] | None = None, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accuracy of every model on the last ``horizon`` rows, fit on the others; and errors of those that fail. ``kept`` and ``keep`` as in ``forecast_all``."""
    train, test = holdout_split(fx, horizon)
    forecasts, failed = forecast_all(train, models, horizon, kept=kept, keep=keep)
    metrics, lost = evaluate(forecasts, test)
    return metrics, failed.withColumn("stage", F.lit("backtest")).unionByName(lost)
