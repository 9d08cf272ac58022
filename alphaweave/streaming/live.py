"""Structured Streaming on incoming bars: sources, tumbling bars, upserts and the rebalance micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LiveConfig
from ..functions import floor_to_interval, is_finite
from ..operators import orders as od
from ..operators.keyed import attach_row
from ..operators.preprocess import preprocess
from ..operators.price_factors import PRICE_FACTORS, price_factors
from ..operators.universe import calendar, with_adj_close
from ..session import materialize
from ..sources.bars import normalize_bars
from ..sources.sinks import path_exists, upsert_bars


def bar_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """File stream of bars or ticks with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def delayed(rows: DataFrame, cfg: LiveConfig, now: str | None = None, time: str = "timestamp") -> DataFrame:
    """Rows not newer than now minus the delay, floored to the bar interval."""
    clock = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    asof = floor_to_interval(clock - F.expr(f"INTERVAL {cfg.delay_minutes} MINUTES"), cfg.bar_minutes)
    return rows.where(F.col(time) <= asof)


def tumbling_bars(ticks: DataFrame, minutes: int = 15, lateness: str = "15 minutes", order: str = "event_id") -> DataFrame:
    """OHLC bars per interval from ticks (ts, ticker, price); works on streams and tables alike.

    Rows later than the allowed lateness are dropped by the watermark and
    counted in the query progress.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", lateness)
    at = F.struct("ts", order)
    return (
        ticks.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "ticker")
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume"),
            F.avg("price").alias("vwap"), F.count("*").cast("double").alias("transactions"),
        )
        .select(F.col("w.start").alias("timestamp"), "ticker", "open", "high", "low", "close", "volume", "vwap", "transactions")
    )


def first_per_key(rows: DataFrame, keys: list[str], lateness: str = "15 minutes", time: str = "ts") -> DataFrame:
    """Stream dedupe where the first row of a key wins, as it arrives; of rows that arrive together any one.

    A key is remembered until the watermark is `lateness` past its first row; rows behind the watermark that the batch
    before started with are dropped and counted (`rows_dropped`), so repeats of a forgotten key do not come out again.
    """
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def rows_dropped(query: StreamingQuery) -> int:
    """Rows that came behind the watermark of the query's stateful operators, over its recent batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of rows that come once: a folder per batch, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink in which the newest row per (timestamp, ticker) wins."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_bars(normalize_bars(batch), path, ("timestamp", "ticker"))

    return write


def recent_history(bars: DataFrame, lookback: int, asof: str | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """Bars of the last `lookback` distinct bar times up to `asof`.

    Only the distinct times are ordered; they are bounded by the history.
    """
    if tickers is not None:
        bars = bars.join(tickers.select("ticker"), "ticker", "left_semi")
    if asof is not None:
        bars = bars.where(F.col("timestamp") <= F.to_timestamp(F.lit(asof)))
    times = bars.select("timestamp").distinct().orderBy(F.desc("timestamp")).limit(lookback)
    return bars.join(F.broadcast(times), "timestamp", "left_semi")


def latest_exposures(
    history: DataFrame, cfg: LiveConfig, names: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Exposures at the newest bar time; no tradable mask.

    Price factors treat bar times as the calendar. Tickers below the coverage
    minimum go, then factors and tickers without any value; the rest is filled
    with 0. Every ticker of the history is in the newest cross-section, with a
    bar or without.
    """
    names = list(names or PRICE_FACTORS)
    bars = history.withColumnRenamed("timestamp", "date")
    cal = materialize(calendar(bars))
    last = cal.agg(F.max("t").alias("t"), F.max("date").alias("date")).first()
    tickers = bars.select("ticker").distinct()
    # A ticker without a newest bar still has windows that reach the newest time.
    now = tickers.withColumn("t", F.lit(last["t"]).cast("int")).withColumn("date", F.lit(last["date"]))
    panel = with_adj_close(bars).join(F.broadcast(cal), "date")
    panel = panel.join(now, ["ticker", "t", "date"], "full_outer")
    raw = price_factors(panel, names, []).where(F.col("t") == last["t"])
    z = materialize(preprocess(materialize(raw), names, cfg.min_factor_names))
    counts = z.agg(*[F.count_if(is_finite(n)).alias(n) for n in names]).first()
    used = [n for n in names if counts[n] > 0]
    if not used:
        return z.select("ticker", "date").limit(0), []
    finite = F.lit(0)
    for n in used:
        finite = finite + is_finite(n).cast("int")
    kept = z.withColumn("__f", finite / len(used)).where((F.col("__f") >= cfg.min_exposure_coverage) & (F.col("__f") > 0))
    counts = kept.agg(*[F.count_if(is_finite(n)).alias(n) for n in used]).first()
    used = [n for n in used if counts[n] > 0]
    return kept.select("ticker", "date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in used]), used


def batch_alpha(exposures: DataFrame, names: list[str], forecast: dict[str, float]) -> DataFrame:
    """(ticker, alpha): exposures times the stored forecast; factors without one count 0."""
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n) * F.lit(float(forecast.get(n) or 0.0))
    return exposures.select("ticker", total.alias("alpha"))


def rebuilt_bars(ticks: DataFrame, batch_id: int, path: str, minutes: int) -> DataFrame:
    """Whole bars of the days that a micro-batch of ticks touches, from all ticks stored so far.

    The batch's ticks go to a folder of their own, which a replay replaces; ticks
    of a day may so arrive in any number of batches and in any order.
    """
    spark = ticks.sparkSession
    ticks.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")
    known = spark.read.parquet(path).where(F.col("batch_id") <= batch_id)
    days = known.where(F.col("batch_id") == batch_id).select("day").distinct()
    return tumbling_bars(known.join(F.broadcast(days), "day", "left_semi").drop("day", "batch_id"), minutes)


class Rebalancer:
    """One micro-batch of the live loop; state lives in tables under `root`.

    Tables: bars (upserted); positions, holding, orders, risk checks and events
    in one folder per batch, written even when empty, and `batches`, one row per
    batch that is complete. A replayed batch starts from the last complete batch
    before it and replaces its own folders whole.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: LiveConfig, forecast: dict[str, float], names: list[str] | None = None, equity: float | None = None):
        self.spark, self.root, self.cfg = spark, root, cfg.validate()
        self.forecast, self.names = forecast, names
        self.equity = equity if equity is not None else cfg.starting_equity

    def _state(self, name: str, schema: str, batch_id: int) -> DataFrame:
        """State as the last earlier batch left it, so a replayed batch starts from the same rows."""
        done = f"{self.root}/batches"
        last = None
        if path_exists(self.spark, done):
            batches = self.spark.read.schema("id bigint").parquet(done)
            last = batches.where(F.col("id") < batch_id).agg(F.max("id")).first()[0]
        if last is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch_id={last}")

    def _save(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        upsert_bars(normalize_bars(batch), f"{self.root}/bars", ("timestamp", "ticker"))
        bars = self.spark.read.parquet(f"{self.root}/bars").drop("day")
        history = materialize(recent_history(bars, self.cfg.lookback_bars))
        x, used = latest_exposures(history, self.cfg, self.names)
        newest = history.join(
            F.broadcast(history.agg(F.max("timestamp").alias("timestamp"))), "timestamp", "left_semi"
        )
        quotes = materialize(od.latest_bars(newest))
        positions = self._state("positions", "ticker string, qty bigint", batch_id)
        holding = self._state("holding", "ticker string, bars_held int", batch_id)
        alpha = od.standardize(materialize(batch_alpha(x, used, self.forecast)))
        cands = materialize(od.signal_filter(alpha, quotes, self.cfg))
        current = materialize(od.weights_from_positions(positions, quotes, self.equity))
        targets = materialize(od.target_portfolio(cands, current, holding, self.cfg))
        orders = od.risk_check(
            od.generate_orders(positions, targets, quotes, self.equity, self.cfg), self.equity, self.cfg.max_position_weight
        )
        orders = materialize(orders)
        safe = orders.where("ok")
        held = positions.selectExpr("ticker", "CASE WHEN qty >= 0 THEN 'BUY' ELSE 'SELL' END AS side", "abs(qty) AS quantity")
        fills = od.positions_from_fills(safe.select("ticker", "side", "quantity").unionByName(held))
        self._save("risk_checks", orders, batch_id)
        self._save("orders", safe, batch_id)
        self._save("holding", materialize(od.next_holding(holding, targets)), batch_id)
        self._save("positions", materialize(fills), batch_id)
        self._save("events", attach_row(od.alpha_stats(cands), od.turnover_between(current, targets)), batch_id)
        self._save("batches", self.spark.createDataFrame([(batch_id,)], "id bigint"), batch_id)


def start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "5 minutes",
    mode: str = "append",
) -> StreamingQuery:
    """Run the sink per micro-batch: everything available and stop, or on an interval."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()

