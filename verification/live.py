"""Live candidates, targets, orders and the streaming operators on event ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaweave.config import LiveConfig, SubmitConfig
from alphaweave.functions import floor_to_interval
from alphaweave.operators import keyed
from alphaweave.operators import orders as od
from alphaweave.session import materialize, shared_dir
from alphaweave.sources import adapters
from alphaweave.sources.bars import latest_positions
from alphaweave.streaming import live

from . import oracle_base as b
from .inputs import month_bars, rounded
from .registry import query

CFG = LiveConfig(
    min_dollar_volume=20_000.0, max_position_weight=0.03, max_net_exposure=0.02, alpha_z_threshold=0.4, starting_equity=5_000_000.0,
)
EQ = CFG.starting_equity

# A snapshot per supplier: a signal from the last two months, a position and a price.
SNAP = f"""{b.MONTH_BARS}, {b.CAL}, lastbar AS (SELECT ticker, arg_max(close, date) AS price, arg_max(close * volume, date) AS dollar_volume FROM bars GROUP BY 1),
prevc AS (SELECT ticker, arg_max(open, date) AS o FROM bars GROUP BY 1),
sig AS (SELECT ticker, (ln(price) - ln(o)) / 50 AS alpha, price, dollar_volume, CAST(substr(ticker, 2) AS BIGINT) AS k FROM lastbar JOIN prevc USING (ticker)),
za AS (SELECT s.*, CASE WHEN sd > 1e-12 THEN (alpha - m) / sd END AS z_alpha FROM sig s, (SELECT avg(alpha) AS m, stddev_pop(alpha) AS sd FROM sig)),
cand AS (SELECT *, coalesce(abs(alpha) - 0.0003 > 0.0005 AND abs(z_alpha) > {CFG.alpha_z_threshold} AND dollar_volume >= {CFG.min_dollar_volume}, false) AS passes_signal FROM za),
pos AS (SELECT ticker, CAST(CASE WHEN k % 2 = 0 THEN k % 11 * 3 ELSE -(k % 7) END AS BIGINT) AS qty, k FROM sig WHERE k % 3 <> 1),
cur AS (SELECT ticker, qty * price / {EQ} AS weight FROM pos JOIN lastbar USING (ticker))"""


class Snapshot:
    def __init__(self, spark, sf):
        bars = month_bars(spark, sf)
        last = keyed.keep_last(bars, ["ticker"], ["date"])
        snap = last.selectExpr(
            "ticker", "close AS price", "close * volume AS dollar_volume", "(ln(close) - ln(open)) / 50 AS alpha",
            "bigint(substr(ticker, 2)) AS k",
        )
        self.snap = materialize(snap)
        self.alpha = self.snap.select("ticker", "alpha")
        self.quotes = self.snap.select("ticker", "price", "dollar_volume")
        self.positions = self.snap.where("k % 3 <> 1").selectExpr(
            "ticker", "bigint(CASE WHEN k % 2 = 0 THEN k % 11 * 3 ELSE -(k % 7) END) AS qty", "k"
        )
        self.current = od.weights_from_positions(self.positions, self.quotes, EQ)
        self.candidates = od.signal_filter(od.standardize(self.alpha), self.quotes, CFG)
        self.holding = self.positions.selectExpr("ticker", "int(k % 6) AS bars_held").where("bars_held > 0")


@query("live_candidates", f"WITH {SNAP} SELECT ticker, {b.rd('alpha', 10)} AS alpha, {b.rd('z_alpha')} AS z_alpha, passes_signal FROM cand")
def live_candidates(spark, sf):
    c = Snapshot(spark, sf).candidates
    return rounded(c.select("ticker", "alpha", "z_alpha", "passes_signal"), alpha=10)


@query(
    "live_alpha_stats",
    f"WITH {SNAP} SELECT {b.rd('avg(alpha)', 10)} AS alpha_mean, {b.rd('stddev_pop(alpha)', 10)} AS alpha_std, count(*) FILTER (WHERE passes_signal) AS number_candidates FROM cand",
)
def live_alpha_stats(spark, sf):
    return rounded(od.alpha_stats(Snapshot(spark, sf).candidates), 10)


@query("current_weights", f"WITH {SNAP} SELECT ticker, {b.rd('weight', 10)} AS weight FROM cur")
def current_weights(spark, sf):
    return rounded(Snapshot(spark, sf).current, 10)


def limits(src: str, out: str) -> str:
    """Exposure limits of `src` (ticker, weight) as CTEs ending in `out`."""
    cap, g, n = CFG.max_position_weight, CFG.max_gross_exposure, CFG.max_net_exposure
    return f"""{out}_a AS (SELECT ticker, least(greatest(weight, -{cap}), {cap}) AS w FROM {src} WHERE weight IS NOT NULL),
{out}_b AS (SELECT ticker, CASE WHEN s > {g} THEN w * {g} / s ELSE w END AS w FROM (SELECT *, sum(abs(w)) OVER () AS s FROM {out}_a)),
{out}_c AS (SELECT *, sum(w) OVER () AS net, count(*) OVER () AS cnt FROM {out}_b),
{out}_d AS (SELECT ticker, abs(net) > {n} AS shifted, CASE WHEN abs(net) > {n} THEN least(greatest(w - (net - sign(net) * {n}) / cnt, -{cap}), {cap}) ELSE w END AS w FROM {out}_c),
{out} AS (SELECT ticker, weight FROM (SELECT ticker, CASE WHEN shifted AND s > {g} THEN w * {g} / s ELSE w END AS weight FROM (SELECT *, sum(abs(w)) OVER () AS s FROM {out}_d)) WHERE abs(weight) > 1e-12)"""


H = CFG.min_holding_period_bars
TURN = CFG.max_turnover_per_rebalance
PORT = f"""{SNAP}, base AS (
  SELECT ticker, CASE WHEN z_alpha > 0 THEN z_alpha / sum(greatest(z_alpha, 0)) OVER () * 0.5 WHEN z_alpha < 0 THEN z_alpha / sum(greatest(-z_alpha, 0)) OVER () * 0.5 END AS weight FROM cand WHERE passes_signal),
{limits('base', 'l1')},
hold AS (SELECT ticker, k % 6 AS held FROM pos WHERE k % 6 > 0),
mh AS (
  SELECT * FROM (SELECT ticker, CASE WHEN abs(c) > 1e-12 AND coalesce(held, {H}) < {H} AND (t = 0 OR sign(t) <> sign(c)) THEN c ELSE t END AS weight
  FROM (SELECT ticker, coalesce(cur.weight, 0) AS c, coalesce(l1.weight, 0) AS t FROM cur FULL OUTER JOIN l1 USING (ticker)) LEFT JOIN hold USING (ticker)) WHERE weight <> 0),
{limits('mh', 'l2')},
al AS (SELECT ticker, coalesce(cur.weight, 0) AS c, coalesce(l2.weight, 0) AS t FROM cur FULL OUTER JOIN l2 USING (ticker)),
tn AS (SELECT 0.5 * sum(abs(t - c)) AS turn FROM al),
tc AS (SELECT ticker, CASE WHEN turn > {TURN} THEN c + (t - c) * {TURN} / turn ELSE t END AS weight FROM al, tn WHERE turn > {TURN} OR t <> 0),
{limits('(SELECT * FROM tc WHERE abs(weight) > 1e-12)', 'tgt')}"""


@query("live_target_weights", f"WITH {PORT} SELECT ticker, {b.rd('weight', 10)} AS weight FROM tgt")
def live_target_weights(spark, sf):
    """Score-proportional targets through exposure, holding and turnover limits."""
    s = Snapshot(spark, sf)
    return rounded(od.target_portfolio(materialize(s.candidates), materialize(s.current), s.holding, CFG), 10)


@query("book_alignment", f"WITH {PORT} SELECT ticker, {b.rd('c', 10)} AS current_weight, {b.rd('t', 10)} AS target_weight FROM al")
def book_alignment(spark, sf):
    """Union of current and target names after the holding rule, absent = 0."""
    s = Snapshot(spark, sf)
    cands = materialize(s.candidates)
    legs = cands.where("passes_signal").agg(F.expr("sum(greatest(z_alpha, 0D)) AS l"), F.expr("sum(greatest(-z_alpha, 0D)) AS h"))
    base = keyed.attach_row(cands.where("passes_signal"), legs).selectExpr("ticker", "CASE WHEN z_alpha > 0 THEN z_alpha / l * 0.5D ELSE z_alpha / h * 0.5D END AS weight")
    cur = materialize(s.current)
    target = od.enforce_limits(od.min_holding(od.enforce_limits(base, CFG), cur, s.holding, CFG), CFG)
    return rounded(keyed.align(cur, target), 10)


@query("target_turnover", f"WITH {PORT} SELECT {b.rd('turn')} AS turnover FROM (SELECT 0.5 * sum(abs(coalesce(tgt.weight, 0) - coalesce(cur.weight, 0))) AS turn FROM cur FULL OUTER JOIN tgt USING (ticker))")
def target_turnover(spark, sf):
    s = Snapshot(spark, sf)
    cur = materialize(s.current)
    tgt = od.target_portfolio(materialize(s.candidates), cur, s.holding, CFG)
    return rounded(od.turnover_between(cur, tgt))


ORDERS = f"""{SNAP}, want AS (SELECT ticker, CASE WHEN k % 2 = 0 THEN alpha ELSE -alpha / 2 END AS weight FROM sig WHERE k % 4 <> 0),
bk AS (SELECT coalesce(p.ticker, w.ticker) AS ticker, coalesce(qty, 0) AS qty, coalesce(weight, 0) AS weight FROM pos p FULL OUTER JOIN want w ON p.ticker = w.ticker),
od AS (SELECT ticker, CAST(trunc(weight * {EQ} / price) AS BIGINT) - qty AS d, price FROM bk JOIN lastbar USING (ticker) WHERE price > 0),
ords AS (
  SELECT ticker, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(d) AS quantity, round(price * CASE WHEN d > 0 THEN 1.0002e0 ELSE 0.9998e0 END, 4) AS limit_price
  FROM od WHERE d <> 0 AND abs(d * price) >= {CFG.min_order_dollars}),
chk AS (SELECT *, quantity * limit_price AS notional, quantity * limit_price <= {EQ} * {CFG.max_position_weight} * 1.1 AS ok FROM ords)"""


def snapshot_orders(spark, sf):
    s = Snapshot(spark, sf)
    want = s.snap.where("k % 4 <> 0").selectExpr("ticker", "CASE WHEN k % 2 = 0 THEN alpha ELSE -alpha / 2 END AS weight")
    orders = materialize(od.generate_orders(s.positions, want, s.quotes, EQ, CFG))
    return s, orders, materialize(od.risk_check(orders, EQ, CFG.max_position_weight))


@query("live_orders", f"WITH {ORDERS} SELECT ticker, side, quantity, {b.rd('limit_price', 3)} AS limit_price, ok, CASE WHEN ok THEN '' ELSE 'size_or_price_limit' END AS reason FROM chk")
def live_orders(spark, sf):
    """Whole-share orders with padded limits and the size check."""
    _, _, checked = snapshot_orders(spark, sf)
    return rounded(checked.select("ticker", "side", "quantity", "limit_price", "ok", "reason"), 3)


@query(
    "submission_rows",
    f"""WITH {ORDERS} SELECT ticker, side, quantity, {b.rd('notional', 1)} AS notional, {b.rd('notional * 0.0003', 4)} AS estimated_total_cost, ok AS risk_ok
FROM (SELECT * FROM chk WHERE ok ORDER BY ticker LIMIT 40)""",
)
def submission_rows(spark, sf):
    """First orders in ticker order with cost estimates and risk flags."""
    _, _, checked = snapshot_orders(spark, sf)
    safe = checked.where("ok").select("ticker", "side", "quantity", "limit_price", "dry_run")
    rows = od.submission_rows(safe, checked, SubmitConfig(max_orders=40))
    return rounded(rows.select("ticker", "side", "quantity", "notional", "estimated_total_cost", "risk_ok"), notional=1, estimated_total_cost=4)


@query(
    "positions_after_fills",
    f"""WITH {ORDERS} SELECT ticker, CAST(sum(q) AS BIGINT) AS qty FROM (
  SELECT ticker, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q FROM ords UNION ALL SELECT ticker, qty FROM pos) GROUP BY 1 HAVING sum(q) <> 0""",
)
def positions_after_fills(spark, sf):
    s, orders, _ = snapshot_orders(spark, sf)
    held = s.positions.selectExpr("ticker", "CASE WHEN qty >= 0 THEN 'BUY' ELSE 'SELL' END AS side", "abs(qty) AS quantity")
    return od.positions_from_fills(orders.select("ticker", "side", "quantity").unionByName(held))


@query(
    "saved_targets_rechecked",
    f"""WITH {SNAP}, saved AS (
  SELECT ticker, 1 AS seq, alpha * 2 AS w, alpha, k % 5 <> 0 AS pf FROM sig UNION ALL SELECT ticker, 2, CASE WHEN k % 3 = 0 THEN 0 ELSE -alpha END, alpha, true FROM sig WHERE k % 2 = 0),
kept AS (SELECT * FROM saved WHERE (abs(w) <= 1e-12 OR CASE WHEN w >= 0 THEN alpha ELSE -alpha END >= 0.0008) AND (abs(w) <= 1e-12 OR pf))
SELECT ticker, {b.rd('weight', 10)} AS weight FROM (SELECT ticker, arg_max(w, seq) AS weight FROM kept GROUP BY 1) WHERE abs(weight) > 1e-12
  AND ticker NOT IN (SELECT ticker FROM sig WHERE price < 5000 AND k % 9 <> 2)""",
)
def saved_targets_rechecked(spark, sf):
    """Saved targets re-filtered, last one per ticker, low-priced names dropped, missing prices passing."""
    s = Snapshot(spark, sf)
    one = s.snap.selectExpr("ticker", "1 AS seq", "alpha * 2 AS target_weight", "alpha AS alpha_score", "CASE WHEN k % 5 <> 0 THEN 'True' ELSE 'no' END AS price_flag")
    two = s.snap.where("k % 2 = 0").selectExpr("ticker", "2 AS seq", "CASE WHEN k % 3 = 0 THEN 0D ELSE -alpha END AS target_weight", "alpha AS alpha_score", "'1' AS price_flag")
    cfg = SubmitConfig(min_price=5000.0)
    kept = od.recheck_targets(one.unionByName(two), cfg, ["seq"])
    prices = s.snap.where("k % 9 <> 2").select("ticker", "price")
    return rounded(od.drop_low_priced(kept, prices, cfg.min_price), 10)


@query(
    "fallback_prices",
    f"""WITH {SNAP}, plan AS (SELECT ticker, 0 AS src, 1 AS seq, price * 0.9 AS p FROM sig WHERE k % 2 = 0 UNION ALL SELECT ticker, 1, 1, CASE WHEN k % 8 = 0 THEN -1 ELSE price * 1.1 END FROM sig WHERE k % 4 = 0),
fb AS (SELECT ticker, arg_max(p, src * 10 + seq) AS p FROM plan WHERE p > 0 GROUP BY 1), lv AS (SELECT ticker, price FROM sig WHERE k % 3 = 0)
SELECT ticker, {b.rd('coalesce(price, p)', 6)} AS price FROM lv FULL OUTER JOIN fb USING (ticker)""",
)
def fallback_prices(spark, sf):
    """Live price, else the last positive price of the stored plans."""
    s = Snapshot(spark, sf)
    ranks = s.snap.where("k % 2 = 0").selectExpr("ticker", "1 AS seq", "price * 0.9 AS signal_price")
    orders = s.snap.where("k % 4 = 0").selectExpr("ticker", "1 AS seq", "CASE WHEN k % 8 = 0 THEN -1D ELSE price * 1.1 END AS execution_price")
    return rounded(od.with_fallback_prices(s.snap.where("k % 3 = 0").select("ticker", "price"), od.plan_prices([ranks, orders])), 6)


@query(
    "dollar_share_plan",
    f"""WITH {SNAP}, d0 AS (SELECT ticker, sign(alpha) * least(abs(alpha * {EQ} / 2), {EQ} * 0.02) AS d FROM sig WHERE alpha <> 0),
d1 AS (SELECT ticker, d * CASE WHEN d > 0 THEN CASE WHEN l > {EQ} * 0.1 THEN {EQ} * 0.1 / l ELSE 1 END ELSE CASE WHEN s > {EQ} * 0.1 THEN {EQ} * 0.1 / s ELSE 1 END END AS d
  FROM d0, (SELECT sum(greatest(d, 0)) AS l, sum(greatest(-d, 0)) AS s FROM d0)),
d2 AS (SELECT * FROM d1 ORDER BY abs(d) DESC, ticker LIMIT 50),
sh AS (SELECT ticker, CAST(sign(d) * floor(abs(d) / price) AS BIGINT) AS q FROM d2 JOIN lastbar USING (ticker) WHERE floor(abs(d) / price) > 0)
SELECT ticker, coalesce(qty, 0) AS current_qty, coalesce(q, 0) AS target_qty, coalesce(q, 0) - coalesce(qty, 0) AS order_qty
FROM sh FULL OUTER JOIN (SELECT ticker, qty FROM pos) USING (ticker) WHERE coalesce(q, 0) <> coalesce(qty, 0)""",
)
def dollar_share_plan(spark, sf):
    """Dollar targets with per-name and per-side caps, largest names, floored shares, order differences."""
    s = Snapshot(spark, sf)
    dollars = od.dollar_targets(s.snap.selectExpr("ticker", "alpha AS weight"), EQ, 2.0, 0.02, 0.10, 50)
    return od.share_plan(dollars, s.quotes, s.positions)


@query(
    "staged_positions",
    "SELECT 'C' || CAST(o_custkey AS VARCHAR) AS ticker, CAST(floor(arg_max(o_totalprice, o_orderkey)) AS BIGINT) AS qty FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS account FROM orders) WHERE account = 'A' GROUP BY 1",
)
def staged_positions(spark, sf):
    """Last staged quantity per ticker of one account."""
    o = adapters.table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS account", "concat('C', o_custkey) AS ticker",
        "floor(o_totalprice) AS qty", "o_orderkey AS seq",
    )
    return latest_positions(o, "A", ["seq"])


@query(
    "holding_ages",
    f"""WITH {SNAP} SELECT s.ticker, CAST(coalesce(held, 0) + 1 AS INTEGER) AS bars_held FROM (SELECT ticker FROM sig WHERE k % 2 = 0) s
LEFT JOIN (SELECT ticker, k % 6 AS held FROM pos WHERE k % 6 > 0) h USING (ticker)""",
)
def holding_ages(spark, sf):
    s = Snapshot(spark, sf)
    return od.next_holding(s.holding, s.snap.where("k % 2 = 0"))


# ---- streaming -----------------------------------------------------------------------------

TICK_SQL = """ticks AS (SELECT ts, 'U' || CAST(user_id AS VARCHAR) AS ticker, value AS price, event_id FROM events),
ib AS (
  SELECT to_timestamp(floor(epoch(ts) / {sec}) * {sec}) AT TIME ZONE 'UTC' AS timestamp, ticker, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
    min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""
SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def tick_stream(spark, sf):
    raw = live.bar_stream(spark, sf, SCHEMA, pathGlobFilter="events.parquet")
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('U', user_id)").alias("ticker"), F.col("value").alias("price"), "event_id"
    )


def scratch(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/alphaweave/{name}-{uuid.uuid4().hex}"


@query("tumbling_bars", f"WITH {TICK_SQL.format(sec=900)} SELECT timestamp, ticker, {b.rnd(['open', 'high', 'low', 'close', 'volume'], 6)} FROM ib")
def tumbling_bars(spark, sf):
    """Fifteen-minute bars by a table aggregation, the batch twin of the stream."""
    bars = live.tumbling_bars(adapters.event_bars(spark, sf), 15)
    return rounded(bars.select("timestamp", "ticker", "open", "high", "low", "close", "volume"), 6)


@query("tumbling_bars_stream", f"WITH {TICK_SQL.format(sec=86400)} SELECT timestamp, ticker, {b.rnd(['open', 'high', 'low', 'close', 'volume'], 6)} FROM ib")
def tumbling_bars_stream(spark, sf):
    """Daily bars from a file stream; windows still open come out too and are replaced as they grow."""
    out, cp = scratch(spark, "bars"), scratch(spark, "cp")
    bars = live.tumbling_bars(tick_stream(spark, sf), 1440, "15 minutes")
    live.start(bars, live.upsert_sink(out), cp, mode="update").awaitTermination()
    got = spark.read.parquet(out)
    return rounded(got.select("timestamp", "ticker", "open", "high", "low", "close", "volume"), 6)


@query(
    "stream_upsert",
    f"WITH {TICK_SQL.format(sec=86400)} SELECT timestamp, ticker, {b.rnd(['close'], 6)} FROM ib",
)
def stream_upsert(spark, sf):
    """Micro-batches upserted by (timestamp, ticker); the newest row wins."""
    out, cp = scratch(spark, "upsert"), scratch(spark, "cp")

    def sink(batch, _):
        from alphaweave.sources.sinks import upsert_bars

        last = keyed.keep_last(
            batch.selectExpr("date_trunc('DAY', ts) AS timestamp", "ticker", "price AS close", "ts", "event_id"),
            ["timestamp", "ticker"], ["ts", "event_id"],
        )
        upsert_bars(last.select("timestamp", "ticker", "close"), out, ("timestamp", "ticker"))

    live.start(tick_stream(spark, sf), sink, cp).awaitTermination()
    return rounded(spark.read.parquet(out).select("timestamp", "ticker", "close"), 6)


ASOF = "2024-01-15 09:10:00"


@query(
    "stream_first_per_bar",
    f"""WITH {TICK_SQL.format(sec=900)} SELECT DISTINCT to_timestamp(floor(epoch(ts) / 900) * 900) AT TIME ZONE 'UTC' AS timestamp, ticker FROM ticks
WHERE epoch(ts) <= floor((epoch(TIMESTAMP '{ASOF}') - {60 * CFG.delay_minutes}) / {60 * CFG.bar_minutes}) * {60 * CFG.bar_minutes}""",
)
def stream_first_per_bar(spark, sf):
    """Delayed ticks in three deliveries, of repeats and late rows too; one row per bar and ticker comes out."""
    ticks = adapters.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('U', user_id)").alias("ticker"), F.col("value").alias("price"))
    end = ticks.agg(F.max("event_id")).first()[0] or 0
    feed, out, cp = scratch(spark, "feed"), scratch(spark, "first"), scratch(spark, "cp")
    # The second delivery repeats a tenth; the third brings the first tenth again, far behind the watermark.
    for part in (f"event_id < {0.6 * end}", f"event_id >= {0.5 * end}", f"event_id < {0.1 * end}"):
        ticks.where(part).coalesce(1).write.mode("append").parquet(feed)
    stream = live.bar_stream(spark, feed, "event_id BIGINT, ts TIMESTAMP, ticker STRING, price DOUBLE", maxFilesPerTrigger=1)
    rows = live.delayed(stream, CFG, ASOF, "ts").withColumn("timestamp", floor_to_interval(F.col("ts"), 15))
    live.start(live.first_per_key(rows, ["timestamp", "ticker"], "60 minutes"), live.append_sink(out), cp).awaitTermination()
    return spark.read.parquet(out).select("timestamp", "ticker")


@query(
    "recent_history",
    f"""WITH {TICK_SQL.format(sec=3600)}, lt AS (SELECT DISTINCT timestamp FROM ib WHERE timestamp <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY 1 DESC LIMIT 48)
SELECT timestamp, ticker, {b.rnd(['close'], 6)} FROM ib WHERE timestamp IN (SELECT timestamp FROM lt)""",
)
def recent_history(spark, sf):
    """Bars of the last 48 bar times before an as-of time."""
    bars = materialize(live.tumbling_bars(adapters.event_bars(spark, sf), 60))
    return rounded(live.recent_history(bars, 48, "2024-01-20 12:00:00").select("timestamp", "ticker", "close"), 6)


MOMZ = f"""{TICK_SQL.format(sec=86400)}, ct AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS t FROM (SELECT DISTINCT timestamp FROM ib)),
pn AS (SELECT ib.*, t FROM ib JOIN ct USING (timestamp)), mx AS (SELECT max(t) AS mt FROM ct), us AS (SELECT DISTINCT ticker FROM ib),
fx AS (SELECT u.ticker, a.close / p1.close - 1 AS mom_1, a.close / a.open - 1 AS intraday_return,
  (SELECT CASE WHEN count(*) >= 10 THEN avg((h.high - h.low) / h.close) END FROM pn h
   WHERE h.ticker = u.ticker AND h.t > mt - 20 AND isfinite((h.high - h.low) / h.close)) AS hl_range_20
  FROM us u CROSS JOIN mx LEFT JOIN pn a ON a.ticker = u.ticker AND a.t = mt LEFT JOIN pn p1 ON p1.ticker = u.ticker AND p1.t = mt - 1)"""
LIVE_F = ["mom_1", "intraday_return", "hl_range_20"]


def live_z() -> str:
    """Bounds are quantiles of the finite values, an infinity is clipped to them; five names at least, and a spread."""
    parts = []
    for n in LIVE_F:
        parts.append(
            f"""q_{n} AS (SELECT quantile_cont({n}, 0.01) AS lo, quantile_cont({n}, 0.99) AS hi, count(*) AS k FROM fx WHERE isfinite({n})),
c_{n} AS (SELECT ticker, least(greatest({n}, lo), hi) AS v FROM fx, q_{n} WHERE k >= 5 AND {n} IS NOT NULL AND NOT isnan({n})),
s_{n} AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM c_{n})"""
        )
    cols = ", ".join(f"(SELECT CASE WHEN s > 1e-12 THEN (v - m) / s END FROM c_{n} q, s_{n} WHERE q.ticker = fx.ticker) AS {n}" for n in LIVE_F)
    return f"{MOMZ}, {', '.join(parts)}, zz AS (SELECT ticker, {cols} FROM fx)"


@query(
    "latest_exposures",
    f"""WITH {live_z()} SELECT ticker, {", ".join(f"{b.rd(f'coalesce({n}, 0)', 7)} AS {n}" for n in LIVE_F)} FROM zz
WHERE {" + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in LIVE_F)} >= 2""",
)
def latest_exposures(spark, sf):
    """Exposures at the newest bar time over daily bars of ticks, coverage-filtered, no tradable mask."""
    bars = materialize(live.tumbling_bars(adapters.event_bars(spark, sf), 1440))
    cfg = LiveConfig(min_factor_names=5, min_exposure_coverage=0.6)
    x, used = live.latest_exposures(bars, cfg, LIVE_F)
    return rounded(x.select("ticker", *used), 7)


@query("live_rebalance_stream")
def live_rebalance_stream(spark, sf):
    """Ticks streamed through bars, exposures, targets and orders per micro-batch; the order log."""
    root, cp = scratch(spark, "live"), scratch(spark, "cp")
    cfg = LiveConfig(
        min_factor_names=5, min_exposure_coverage=0.3, min_dollar_volume=0.0, alpha_z_threshold=0.2, min_order_dollars=1.0, lookback_bars=60
    )
    step = live.Rebalancer(spark, root, cfg, {"mom_1": 0.01, "intraday_return": -0.02}, ["mom_1", "intraday_return", "hl_range_20"])

    def sink(batch, batch_id):
        step(materialize(live.rebuilt_bars(batch, batch_id, f"{root}/ticks", 1440)), batch_id)

    live.start(tick_stream(spark, sf), sink, cp).awaitTermination()
    return spark.read.parquet(f"{root}/orders").select("batch_id", "ticker", "side", "quantity", "limit_price")
