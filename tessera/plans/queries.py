"""The engine's queries on the driver's tables, each beside the SQL that must give the
same rows. Bars come from ``events``; doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import tidy
from ..operators import analytics as A
from ..operators import asof as J
from ..operators import backtest as B
from ..operators import features as X
from ..operators import portfolio as P
from ..operators import transforms as T
from ..operators.universe import UniverseRules, apply_universe
from ..sources import bars as S
from ..sources.tables import split_adjust
from . import experiments as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns (all, if none), doubles rounded, counts as bigint."""
    kinds = dict(df.dtypes)
    fix = {"double": lambda c: tidy(F.col(c)), "int": lambda c: F.col(c).cast("bigint"), "float": lambda c: tidy(F.col(c).cast("double"))}
    return df.select(*[fix.get(kinds[c], F.col)(c).alias(c) for c in (columns or df.columns)])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


#: Bars, returns and the benchmark as the SQL side makes them.
SQL = """WITH bars AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, sum(value) AS volume FROM events WHERE value > 0 GROUP BY 1, 2),
p0 AS (SELECT *, lag(close) OVER w AS pc, close / lag(close) OVER w - 1 AS ret, close * volume AS dv, ln(close * volume) AS ldv, ln(volume) AS lv,
  close / lag(close, 2) OVER w - 1 AS m2, lead(close) OVER w / close - 1 AS f1, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
bench AS (SELECT date, coalesce(avg(ret), 0) AS b FROM p0 GROUP BY date),
p AS (SELECT p0.*, bench.b, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, date_part('day', date) % 3 AS g, (('x' || symbol) < 'x5')::INT AS big FROM p0 JOIN bench USING (date))
"""


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def over(agg: str, n: int, before: bool = False) -> str:
    frame = f"{n} PRECEDING AND 1 PRECEDING" if before else f"{n - 1} PRECEDING AND CURRENT ROW"
    return f"{agg} OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {frame})"


def full(agg: str, x: str, n: int, before: bool = False) -> str:
    return f"(CASE WHEN {over(f'count({x})', n, before)} = {n} THEN {over(agg, n, before)} END)"


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_returns(S.bars(spark, sf))


def signal_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with return, momentum over 2 rows, the next return and two group labels."""
    df = X.forward_return(X.momentum(panel(spark, sf), 2), 1)
    return df.withColumns({"g": F.dayofmonth("date") % 3, "big": (F.concat(F.lit("x"), "symbol") < "x5").cast("int")})


def benched(spark: SparkSession, sf: str) -> DataFrame:
    df = panel(spark, sf)
    return X.with_benchmark(df, S.benchmark_returns(df))


query("bars", SQL + f"SELECT date, symbol, {r('open','open')}, {r('high','high')}, {r('low','low')}, {r('close','close')}, {r('volume','volume')} FROM bars")(lambda s, d: out(S.bars(s, d)))
query("returns_labels", SQL + f"SELECT date, symbol, {r('ret','daily_return')}, {r('ln(1 + ret)','log_return')}, {r('f1','forward_return_1d')}, {r('lead(close, 3) OVER (PARTITION BY symbol ORDER BY date) / close - 1','forward_return_3d')} FROM p")(
    lambda s, d: out(X.forward_return(X.forward_return(X.returns(S.bars(s, d)), 1), 3), "date", "symbol", "daily_return", "log_return", "forward_return_1d", "forward_return_3d")
)


def feature(name: str, build, columns: dict[str, str], source=panel):
    """A feature query: output columns and the SQL expression of each."""
    sql = SQL + "SELECT date, symbol, " + ", ".join(r(x, c) for c, x in columns.items()) + " FROM p"
    query(name, sql)(lambda s, d: out(build(source(s, d)), "date", "symbol", *columns))


N = 4
feature("rolling_vol", lambda df: X.rolling_volatility(df, N), {f"rolling_volatility_{N}d": full("stddev_samp(ret)", "ret", N)})
feature("avg_volume", lambda df: X.average_volume(df, N), {f"rolling_average_volume_{N}d": full("avg(volume)", "volume", N)})
feature("atr", lambda df: X.average_true_range(df, N), {f"average_true_range_{N}d": full("avg(tr)", "tr", N)})
feature("natr", lambda df: X.normalized_average_true_range(df, N), {f"normalized_average_true_range_{N}d": full("avg(tr)", "tr", N) + " / close"})
feature("amihud", lambda df: X.amihud(df, N), {f"amihud_illiquidity_{N}d": full("avg(abs(ret) / dv)", "abs(ret) / dv", N)})
feature("dv_shock", lambda df: X.dollar_volume_shock(df, N), {f"dollar_volume_shock_{N}d": "ldv - " + full("avg(ldv)", "ldv", N, True)})
feature("volume_shock", lambda df: X.volume_shock(df, N), {f"volume_shock_{N}d": "lv - " + full("avg(lv)", "lv", N, True)})
feature("dv_zscore", lambda df: X.dollar_volume_zscore(df, N), {f"dollar_volume_zscore_{N}d": f"(ldv - {full('avg(ldv)', 'ldv', N, True)}) / nullif({full('stddev_samp(ldv)', 'ldv', N, True)}, 0)"})
feature("rel_volume", lambda df: X.relative_volume(df, N), {f"relative_volume_{N}d": "volume / " + full("avg(volume)", "volume", N, True)})
feature("rel_dv", lambda df: X.relative_dollar_volume(df, N), {f"relative_dollar_volume_{N}d": "dv / " + full("avg(dv)", "dv", N, True)})
_GK = "0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2"
_RS = "ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close)"
_gk = full(f"avg({_GK})", _GK, N)
feature("garman_klass", lambda df: X.garman_klass(df, N), {f"garman_klass_volatility_{N}d": f"CASE WHEN {_gk} > 0 THEN sqrt({_gk}) END"})
feature("parkinson", lambda df: X.parkinson(df, N), {f"parkinson_volatility_{N}d": "sqrt(" + full("avg(ln(high / low) ** 2 / (4 * ln(2)))", "ln(high / low)", N) + ")"})
_rs = full(f"avg({_RS})", _RS, N)
feature("rogers_satchell", lambda df: X.rogers_satchell(df, N), {f"rogers_satchell_volatility_{N}d": f"CASE WHEN {_rs} >= 0 THEN sqrt({_rs}) END"})
_k = f"(0.34 / (1.34 + {N + 1}.0 / {N - 1}))"
_yz = f"({full('var_samp(ln(open / pc))', 'ln(open / pc)', N)} + {_k} * {full('var_samp(ln(close / open))', 'ln(close / open)', N)} + (1 - {_k}) * {_rs})"
feature("yang_zhang", lambda df: X.yang_zhang(df, N), {f"yang_zhang_volatility_{N}d": f"CASE WHEN {_yz} >= 0 THEN sqrt({_yz}) END"})
_rms = lambda x: f"sqrt({full(f'avg(({x}) ** 2)', 'ret', N)})"
feature("realized_family", lambda df: X.realized_family(df, N), {f"realized_volatility_{N}d": _rms("ret"), f"realized_downside_volatility_{N}d": _rms("CASE WHEN ret < 0 THEN ret WHEN ret IS NOT NULL THEN 0 END"), f"realized_upside_volatility_{N}d": _rms("CASE WHEN ret > 0 THEN ret WHEN ret IS NOT NULL THEN 0 END")})
feature("higher_moments", lambda df: X.higher_moments(df, 6), {"rolling_skewness_6d": full("skewness(ret)", "ret", 6), "rolling_kurtosis_6d": full("kurtosis(ret)", "ret", 6)})
_bb = lambda x: f"(CASE WHEN ret IS NOT NULL THEN {x} END)"
_cov, _vb, _vr = full(f"covar_samp(ret, {_bb('b')})", "ret", N), full(f"var_samp({_bb('b')})", "ret", N), full("var_samp(ret)", "ret", N)
feature("bench_beta_corr", lambda df: X.benchmark_statistics(df, N), {f"rolling_benchmark_beta_{N}d": f"{_cov} / nullif({_vb}, 0)", f"rolling_benchmark_correlation_{N}d": f"{_cov} / nullif(sqrt({_vb}), 0) / nullif(sqrt({_vr}), 0)"}, benched)
_pb = f"({full(f'covar_samp(ret, {_bb(chr(98))})', 'ret', N, True)} / nullif({full(f'var_samp({_bb(chr(98))})', 'ret', N, True)}, 0))"
feature("bench_residual", lambda df: X.benchmark_residual(df, N), {f"benchmark_residual_return_{N}d": f"ret - ({full('avg(ret)', 'ret', N, True)} - {_pb} * {full(f'avg({_bb(chr(98))})', 'ret', N, True)} + {_pb} * b)"}, benched)
feature("sig_momentum", lambda df: X.factor_signal(df, "momentum", lookback=2)[0], {"momentum_signal_2d": "m2"})
feature("sig_mean_reversion", lambda df: X.factor_signal(df, "mean_reversion", lookback=2)[0], {"mean_reversion_signal_2d": "-m2"})
feature("sig_trend", lambda df: X.factor_signal(df, "trend", short=2, long=5)[0], {"trend_signal_2_5d": f"{full('avg(close)', 'close', 2)} / {full('avg(close)', 'close', 5)} - 1"})

# As-of joins. Records: the latest signup of a symbol-day; a third of the payloads is missing.
_EV = SQL + """, ev AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS eff, arg_max(value, ts) AS value FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
days AS (SELECT DISTINCT date FROM bars)"""


def _records(s, d):
    return S.effective_events(s, d)


def _asof_sql(op: str) -> str:
    return _EV + f""", av AS (SELECT symbol, value, (SELECT min(date) FROM days WHERE date {op} eff) AS av_on FROM ev)
SELECT p.date, p.symbol, {r('CASE WHEN av.value > 40 THEN av.value END', 'asof_value')}, av.value > 60 AS asof_flag FROM p ASOF LEFT JOIN (SELECT * FROM av WHERE av_on IS NOT NULL) av ON p.symbol = av.symbol AND p.date >= av.av_on"""


def _asof(strict):
    values = {"asof_value": F.when(F.col("value") > 40, F.col("value")), "asof_flag": F.col("value") > 60}
    return lambda s, d: out(J.attach(panel(s, d), _records(s, d), values, "effective_date", strict=strict), "date", "symbol", "asof_value", "asof_flag")


QUERIES["asof_strict"], ORACLE["asof_strict"] = lambda s, d: _asof(True)(s, d), _asof_sql(">")
QUERIES["asof_effective"], ORACLE["asof_effective"] = lambda s, d: _asof(False)(s, d), _asof_sql(">=")

# Fundamentals: the last purchase (revenue) and view (assets) of a week, released on its day.
_FUND = SQL + """, fu AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CASE event_type WHEN 'purchase' THEN 'revenue' ELSE 'assets' END AS metric, date_trunc('week', CAST(ts AS DATE))::DATE AS period,
  max(CAST(ts AS DATE)) AS release, arg_max(value, ts) AS value FROM events WHERE event_type IN ('purchase', 'view') AND value > 0 GROUP BY 1, 2, 3),
days AS (SELECT DISTINCT date FROM bars)"""


def fundamentals(s, d):
    e = S.events(s, d).where("event_type IN ('purchase', 'view') AND value > 0")
    day = F.to_date("ts")
    g = e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.when(F.col("event_type") == "purchase", "revenue").otherwise("assets").alias("metric_name"), F.date_trunc("week", day).cast("date").alias("period_end_date"))
    return g.agg(F.max(day).alias("release_date"), F.max_by("value", "ts").alias("metric_value"))


def _av(source: str, metric: str) -> str:
    return f"(SELECT symbol, value, av_on FROM (SELECT symbol, value, (SELECT min(date) FROM days WHERE date > release) AS av_on FROM {source} WHERE metric = '{metric}') WHERE av_on IS NOT NULL)"


_JOIN2 = f"""FROM p ASOF LEFT JOIN {_av('fu', 'revenue')} rv ON p.symbol = rv.symbol AND p.date >= rv.av_on ASOF LEFT JOIN {_av('fu', 'assets')} aa ON p.symbol = aa.symbol AND p.date >= aa.av_on"""


@query("ratios", _FUND + f" SELECT p.date, p.symbol, {r('rv.value', 'fundamental_revenue')}, {r('rv.value / p.close', 'valuation_revenue_to_price')}, {r('CASE WHEN aa.value > 0 THEN rv.value / aa.value END', 'quality_revenue_to_assets')} {_JOIN2}")
def _ratios(s, d):
    df = J.attach_fundamentals(panel(s, d), fundamentals(s, d), ["revenue", "assets"])
    df = X.guarded_ratio(X.price_ratio(df, "fundamental_revenue", "valuation_revenue_to_price"), "quality_revenue_to_assets", "fundamental_revenue", "fundamental_assets")
    return out(df, "date", "symbol", "fundamental_revenue", "valuation_revenue_to_price", "quality_revenue_to_assets")


@query("growth", _FUND + f""", gr0 AS (SELECT *, lag(value) OVER w AS pv, lag(release) OVER w AS pr FROM fu WINDOW w AS (PARTITION BY symbol, metric ORDER BY period)),
gr AS (SELECT symbol, metric, release, value / pv - 1 AS value FROM gr0 WHERE pv > 0 AND pr <= release)
SELECT p.date, p.symbol, {r('rv.value', 'growth_revenue')} FROM p ASOF LEFT JOIN {_av('gr', 'revenue')} rv ON p.symbol = rv.symbol AND p.date >= rv.av_on""")
def _growth(s, d):
    return out(J.attach_growth(panel(s, d), fundamentals(s, d), ["revenue"]), "date", "symbol", "growth_revenue")


_EDGE = lambda k: f"(CASE WHEN (n - 1) * {k} - floor((n - 1) * {k}) < 0.5 THEN l[floor((n - 1) * {k})::INT + 1] + (l[least(floor((n - 1) * {k})::INT + 2, n)] - l[floor((n - 1) * {k})::INT + 1]) * ((n - 1) * {k} - floor((n - 1) * {k})) ELSE l[least(floor((n - 1) * {k})::INT + 2, n)] - (l[least(floor((n - 1) * {k})::INT + 2, n)] - l[floor((n - 1) * {k})::INT + 1]) * (1 - ((n - 1) * {k} - floor((n - 1) * {k}))) END)"
_GRID = ["0.0::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE", "0.75::DOUBLE", "1.0::DOUBLE"]


@query("cap_buckets", _EV + f""", av AS (SELECT symbol, 1000 + value AS shares, (SELECT min(date) FROM days WHERE date >= eff) AS av_on FROM ev),
c AS (SELECT p.date, p.symbol, p.close * av.shares AS market_cap FROM p ASOF LEFT JOIN (SELECT * FROM av WHERE av_on IS NOT NULL) av ON p.symbol = av.symbol AND p.date >= av.av_on),
l AS (SELECT date, list(market_cap ORDER BY market_cap) AS l, count(*)::INT AS n FROM c WHERE market_cap IS NOT NULL GROUP BY date),
e AS (SELECT date, n, [{', '.join(map(_EDGE, _GRID))}] AS e, len(list_distinct(l)) AS k FROM l)
SELECT c.date, c.symbol, {r('market_cap', 'market_cap')}, CASE WHEN market_cap IS NOT NULL AND n >= 4 AND k >= 4 AND len(list_distinct(e)) = 5 THEN greatest(1, len(list_filter(e, lambda x: x < market_cap)))::BIGINT END AS market_cap_bucket FROM c LEFT JOIN e USING (date)""")
def _cap_buckets(s, d):
    shares = _records(s, d).select("symbol", "effective_date", (F.lit(1000) + F.col("value")).alias("shares_outstanding"))
    return out(J.market_cap_buckets(J.attach_shares(panel(s, d), shares), 4), "date", "symbol", "market_cap", "market_cap_bucket")


@query("split_adjusted", SQL + f""", sp AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS ex FROM events WHERE event_type = 'signup' GROUP BY 1, 2 HAVING max(value) > 90)
SELECT date, symbol, {r('close / f', 'close')}, {r('volume * f', 'volume')}, {r('f', 'volume_adjustment_factor')} FROM (SELECT date, symbol, close, volume, power(2.0, (SELECT count(*) FROM sp WHERE sp.symbol = bars.symbol AND sp.ex > bars.date)) AS f FROM bars)""")
def _split(s, d):
    e = S.events(s, d).where("event_type = 'signup'").groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("ex_date")).agg(F.max("value").alias("v")).where("v > 90")
    actions = e.select("symbol", "ex_date", F.lit("split").alias("action_type"), F.lit(2.0).alias("split_ratio"))
    return out(split_adjust(S.bars(s, d), actions), "date", "symbol", "close", "volume", "volume_adjustment_factor")


_AV2, _ADV2 = full("avg(volume)", "volume", 2), full("avg(dv)", "dv", 2)
_U = f"""SELECT date, symbol, rn, lag(close) OVER w AS lc, lag(a) OVER w AS la, lag(dd) OVER w AS ld, close, m2, f1 FROM (SELECT *, {_AV2} AS a, {_ADV2} AS dd FROM p) WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
RULES = UniverseRules(min_price=20, min_average_volume=60, average_volume_window=2, min_average_dollar_volume=3000, dollar_volume_window=2, min_listing_days=4)
_UNIVERSE = SQL + f", u AS ({_U}), " + """e AS (SELECT *, rn > 1 AND rn - 1 >= 4 AND coalesce(lc >= 20, false) AND coalesce(la >= 60, false) AND coalesce(ld >= 3000, false) AS ok,
concat_ws(';', CASE WHEN rn <= 1 THEN 'insufficient_universe_history' END, CASE WHEN rn > 1 AND rn - 1 < 4 THEN 'insufficient_listing_history' END, CASE WHEN rn > 1 AND lc < 20 THEN 'below_min_price' END,
CASE WHEN rn > 1 AND la IS NULL THEN 'insufficient_average_volume_history' END, CASE WHEN rn > 1 AND la < 60 THEN 'below_min_average_volume' END,
CASE WHEN rn > 1 AND ld IS NULL THEN 'insufficient_adv_history' END, CASE WHEN rn > 1 AND ld < 3000 THEN 'below_min_average_dollar_volume' END) AS reason FROM u)"""
query("universe", _UNIVERSE + " SELECT date, symbol, ok AS is_universe_eligible, reason AS universe_exclusion_reason FROM e")(lambda s, d: out(apply_universe(panel(s, d), RULES), "date", "symbol", "is_universe_eligible", "universe_exclusion_reason"))
query("universe_reasons", _UNIVERSE + " SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(reason, ';')) AS reason FROM e WHERE reason <> '') GROUP BY reason")(lambda s, d: out(A.reason_histogram(apply_universe(panel(s, d), RULES))))
query("universe_summary", _UNIVERSE + f" SELECT count(*) AS rows, count_if(ok) AS eligible_rows, count(DISTINCT CASE WHEN ok THEN symbol END) AS symbols_ever_eligible, min(n) AS min_per_date, {r('avg(n)', 'avg_per_date')}, max(n) AS max_per_date FROM (SELECT *, (count_if(ok) OVER (PARTITION BY date))::BIGINT AS n, row_number() OVER (PARTITION BY date) AS k FROM e)".replace("avg(n)", "avg(CASE WHEN k = 1 THEN n END)"))(
    lambda s, d: out(A.universe_summary(apply_universe(panel(s, d), RULES)))
)

# Same-date transforms of momentum.
M = "momentum_signal_2d"
_D = "OVER (PARTITION BY date)"


def transform(name: str, build, suffix: str, x: str, inner: str = "p"):
    query(name, SQL + f"SELECT date, symbol, {r(x, f'{M}_{suffix}')} FROM {inner}")(lambda s, d: out(build(signal_panel(s, d)), "date", "symbol", f"{M}_{suffix}"))


transform("winsorize", lambda df: T.winsorize(df, M, 0.1), "winsorized", f"CASE WHEN m2 IS NOT NULL THEN least(greatest(m2, quantile_cont(m2, 0.1) {_D}), quantile_cont(m2, 0.9) {_D}) END")
transform("clip", lambda df: T.clipped(df, M, -0.5, 0.5), "clipped", "CASE WHEN m2 IS NOT NULL THEN least(greatest(m2, -0.5), 0.5) END")
transform("demean", lambda df: T.demean(df, M), "demeaned", f"CASE WHEN count(m2) {_D} >= 2 THEN m2 - avg(m2) {_D} END")
transform("demean_group", lambda df: T.demean(df, M, "big"), "demeaned", "CASE WHEN count(m2) OVER (PARTITION BY date, big) >= 2 THEN m2 - avg(m2) OVER (PARTITION BY date, big) END")
transform("residualize_1", lambda df: T.residualize(df.withColumn("lv", F.ln("volume")), M, ["lv"]), "residualized", f"CASE WHEN count(m2) {_D} >= 3 AND m2 IS NOT NULL THEN m2 - avg(m2) {_D} - covar_samp(m2, x) {_D} / nullif(var_samp(x) {_D}, 0) * (x - avg(x) {_D}) END", "(SELECT *, CASE WHEN m2 IS NOT NULL THEN lv END AS x FROM p)")
transform("zscore", lambda df: T.zscore(df, M), "zscore", f"CASE WHEN count(m2) {_D} >= 2 THEN (m2 - avg(m2) {_D}) / nullif(stddev_pop(m2) {_D}, 0) END")
transform("robust_zscore", lambda df: T.robust_zscore(df, M), "robust_zscore", f"CASE WHEN count(m2) {_D} >= 2 THEN (m2 - md) / nullif(1.4826 * median(abs(m2 - md)) {_D}, 0) END", f"(SELECT *, median(m2) {_D} AS md FROM p)")
transform("rank_norm", lambda df: T.rank_normalize(df, M), "rank", f"CASE WHEN m2 IS NOT NULL AND count(m2) {_D} >= 2 THEN (rank() OVER (PARTITION BY date, m2 IS NULL ORDER BY m2) + (count(*) OVER (PARTITION BY date, m2) - 1) / 2.0 - 1) / (count(m2) {_D} - 1) END")


@query("transform_chain", SQL + f""", w AS (SELECT *, CASE WHEN m2 IS NOT NULL THEN least(greatest(m2, quantile_cont(m2, 0.05) {_D}), quantile_cont(m2, 0.95) {_D}) END AS x FROM p), c AS (SELECT *, least(greatest(x, -0.8), 0.8) AS y FROM w)
SELECT date, symbol, {r(f'CASE WHEN x IS NOT NULL THEN (y - avg(CASE WHEN x IS NOT NULL THEN y END) {_D}) / nullif(stddev_pop(CASE WHEN x IS NOT NULL THEN y END) {_D}, 0) END', 'signal')} FROM c""")
def _chain(s, d):
    df, name = T.standard_transform(signal_panel(s, d), M, winsorize_quantile=0.05, clip_bounds=(-0.8, 0.8), normalization="zscore")
    return out(df.withColumn("signal", F.col(name)), "date", "symbol", "signal")


# Normal equations of two exposures, from same-date moments of complete rows.
_MOM = ", ".join(f"{f} {_D} AS {n}" for n, f in {"n": "count(y)", "my": "avg(y)", "ma": "avg(a)", "mb": "avg(b)", "va": "var_samp(a)", "vb": "var_samp(b)", "cab": "covar_samp(a, b)", "cay": "covar_samp(a, y)", "cby": "covar_samp(b, y)"}.items())
query("residualize_many", SQL + f""", q AS (SELECT date, symbol, m2 AS y, CASE WHEN m2 IS NOT NULL THEN lv END AS a, CASE WHEN m2 IS NOT NULL THEN ln(close) END AS b FROM p), mo AS (SELECT *, {_MOM} FROM q)
SELECT date, symbol, {r('CASE WHEN n >= 4 AND va * vb - cab * cab > 1e-12 THEN y - my - (cay * vb - cby * cab) / (va * vb - cab * cab) * (a - ma) - (cby * va - cay * cab) / (va * vb - cab * cab) * (b - mb) END', f'{M}_residualized')} FROM mo""")(
    lambda s, d: out(T.residualize(signal_panel(s, d).withColumns({"lv": F.ln("volume"), "lc": F.ln("close")}), M, ["lv", "lc"]), "date", "symbol", f"{M}_residualized")
)

# Factor diagnostics.
_IC = SQL + """, q AS (SELECT date, symbol, g, big, CASE WHEN f1 IS NOT NULL THEN m2 END AS s, CASE WHEN m2 IS NOT NULL THEN f1 END AS f FROM p),
ic AS (SELECT date, count(s) AS observations, CASE WHEN count(s) >= 2 AND var_samp(s) > 0 AND var_samp(f) > 0 THEN covar_samp(s, f) / sqrt(var_samp(s)) / sqrt(var_samp(f)) END AS ic FROM q GROUP BY date)"""
_ics = lambda s, d: A.ic_series(signal_panel(s, d), M, "forward_return_1d")
query("ic_pearson", _IC + f" SELECT date, observations, {r('ic', 'ic')} FROM ic")(lambda s, d: out(_ics(s, d)))
query("ic_spearman", _IC + f""", k AS (SELECT date, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY date, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0 END AS s, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY date, f IS NULL ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 END AS f FROM q)
SELECT date, count(s) AS observations, {r('CASE WHEN count(s) >= 2 AND var_samp(s) > 0 AND var_samp(f) > 0 THEN covar_samp(s, f) / sqrt(var_samp(s)) / sqrt(var_samp(f)) END', 'ic')} FROM k GROUP BY date""")(lambda s, d: out(A.ic_series(signal_panel(s, d), M, "forward_return_1d", "spearman")))
_SUM = f"count(*) AS periods, count(ic) AS valid_periods, {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'ic_std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'ic_ir')}, {r('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)', 'positive_ratio')}"
query("ic_summary", _IC + f" SELECT {_SUM} FROM ic")(lambda s, d: out(A.ic_summary(_ics(s, d))))
_W5 = "OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
query("rolling_ic", _IC + f" SELECT date, {r('ic', 'ic')}, {r(f'CASE WHEN count(ic) {_W5} >= 3 THEN avg(ic) {_W5} END', 'rolling_mean_ic')}, {r(f'CASE WHEN count(ic) {_W5} >= 3 THEN avg(ic) {_W5} / nullif(stddev_samp(ic) {_W5}, 0) END', 'rolling_ic_ir')} FROM ic")(lambda s, d: out(A.rolling_ic(_ics(s, d), 5, 3)))
query("rolling_ic_summary", _IC + f", ro AS (SELECT date, CASE WHEN count(ic) {_W5} >= 3 THEN avg(ic) {_W5} END AS m FROM ic) SELECT {r('arg_max(m, date) FILTER (WHERE m IS NOT NULL)', 'latest_rolling_mean_ic')}, {r('min(m)', 'min_rolling_mean_ic')}, {r('max(m)', 'max_rolling_mean_ic')}, count(m) AS valid_windows FROM ro")(lambda s, d: out(A.rolling_ic_summary(A.rolling_ic(_ics(s, d), 5, 3))))
_HOR = SQL + """, h AS (SELECT date, symbol, m2, f1, lead(close, 3) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS f3 FROM p), lo AS (SELECT date, 1 AS horizon, m2 AS s, f1 AS f FROM h UNION ALL SELECT date, 3, m2, f3 FROM h),
ic AS (SELECT date, horizon, count(CASE WHEN s IS NOT NULL THEN f END) AS observations, covar_samp(s, f) / nullif(sqrt(var_samp(CASE WHEN f IS NOT NULL THEN s END)), 0) / nullif(sqrt(var_samp(CASE WHEN s IS NOT NULL THEN f END)), 0) AS ic FROM lo GROUP BY date, horizon)"""
_decay = lambda s, d: A.ic_decay(X.forward_return(signal_panel(s, d), 3), M, {1: "forward_return_1d", 3: "forward_return_3d"})
query("ic_decay", _HOR + f" SELECT date, horizon::BIGINT AS horizon, observations, {r('ic', 'ic')} FROM ic")(lambda s, d: out(_decay(s, d)))
query("ic_decay_summary", _HOR + f" SELECT horizon::BIGINT AS horizon, {_SUM} FROM ic GROUP BY horizon")(lambda s, d: out(A.ic_summary(_decay(s, d), ("horizon",))))
_GIC = _IC + ", gi AS (SELECT date, big, count(s) AS observations, CASE WHEN count(s) >= 2 AND var_samp(s) > 0 AND var_samp(f) > 0 THEN covar_samp(s, f) / sqrt(var_samp(s)) / sqrt(var_samp(f)) END AS ic FROM q GROUP BY date, big)"
_gic = lambda s, d: A.ic_series(signal_panel(s, d), M, "forward_return_1d", group="big")
query("grouped_ic", _GIC + f" SELECT date, big::BIGINT AS big, observations, {r('ic', 'ic')} FROM gi")(lambda s, d: out(_gic(s, d)))
query("grouped_ic_summary", _GIC + f" SELECT big::BIGINT AS big, {_SUM} FROM gi GROUP BY big")(lambda s, d: out(A.ic_summary(_gic(s, d), ("big",))))


def _rank_edge(k: str) -> str:
    v = f"((n - 1)::DOUBLE * {k}::DOUBLE)"
    p, g = f"floor({v})", f"({v} - floor({v}))"
    a, b = f"({p} + 1)", f"least({p} + 2, n::DOUBLE)"
    return f"(CASE WHEN (CASE WHEN {g} < 0.5 THEN {a} + ({b} - {a}) * {g} ELSE {b} - ({b} - {a}) * (1 - {g}) END) < k THEN 1 ELSE 0 END)"


_QT = SQL + f""", qr AS (SELECT date, symbol, f1 AS f, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY m2, symbol) AS k FROM p WHERE m2 IS NOT NULL AND f1 IS NOT NULL),
qb AS (SELECT date, symbol, f, greatest(1, {' + '.join(_rank_edge(x) for x in ('0.0', '0.25', '0.5', '0.75', '1.0'))})::BIGINT AS bucket FROM qr WHERE n >= 4), qd AS (SELECT date, bucket, avg(f) AS mean_return FROM qb GROUP BY date, bucket)"""
_qrows = lambda s, d: A.quantile_rows(signal_panel(s, d), M, "forward_return_1d", 4)
_qd = lambda s, d: A.quantile_daily(_qrows(s, d))
query("quantile_rows", _QT + " SELECT date, symbol, bucket FROM qb")(lambda s, d: out(_qrows(s, d), "date", "symbol", "bucket"))
query("quantile_returns", _QT + f" SELECT bucket, count(*) AS dates, {r('avg(mean_return)', 'average_return')} FROM qd GROUP BY bucket")(lambda s, d: out(A.quantile_returns(_qd(s, d))))
query("quantile_cumulative", _QT + f" SELECT date, bucket, {r('product(1 + mean_return) OVER (PARTITION BY bucket ORDER BY date) - 1', 'cumulative_return')} FROM qd")(lambda s, d: out(A.quantile_cumulative(_qd(s, d))))
_SP = _QT + ", sp AS (SELECT date, CASE WHEN count(*) >= 2 THEN arg_max(mean_return, bucket) - arg_min(mean_return, bucket) END AS spread FROM qd GROUP BY date)"
query("quantile_spread", _SP + f" SELECT date, {r('spread', 'spread')} FROM sp")(lambda s, d: out(A.quantile_spread(_qd(s, d))))
query("spread_summary", _SP + f" SELECT {r('avg(spread)', 'mean_spread')}, {r('stddev_samp(spread)', 'spread_std')}, {r('avg(CASE WHEN spread > 0 THEN 1.0 WHEN spread IS NOT NULL THEN 0.0 END)', 'positive_ratio')}, {r('avg(CASE WHEN spread < 0 THEN 1.0 WHEN spread IS NOT NULL THEN 0.0 END)', 'negative_ratio')}, {r('arg_max(spread, date) FILTER (WHERE spread IS NOT NULL)', 'latest_spread')} FROM sp")(lambda s, d: out(A.spread_summary(A.quantile_spread(_qd(s, d)))))
_CV = "count(*) AS total, count(m2) AS signals, count(f1) AS labels, count(CASE WHEN m2 IS NOT NULL THEN f1 END) AS usable"
query("coverage", SQL + f"SELECT date, {_CV} FROM p GROUP BY date")(lambda s, d: out(A.coverage(signal_panel(s, d), M, "forward_return_1d")))
query("grouped_coverage", SQL + f"SELECT date, big::BIGINT AS big, {_CV} FROM p GROUP BY date, big")(lambda s, d: out(A.coverage(signal_panel(s, d), M, "forward_return_1d", "big")))
_CS = f"sum(total)::BIGINT AS total, sum(usable)::BIGINT AS usable, {r('sum(signals) / sum(total)', 'signal_coverage')}, {r('sum(labels) / sum(total)', 'label_coverage')}, {r('sum(usable) / sum(total)', 'joint_coverage')}, {r('avg(usable)', 'average_usable')}, min(usable) AS min_usable"
query("coverage_summary", SQL + f", c AS (SELECT date, {_CV} FROM p GROUP BY date) SELECT {_CS} FROM c")(lambda s, d: out(A.coverage_summary(A.coverage(signal_panel(s, d), M, "forward_return_1d"))))
query("grouped_coverage_summary", SQL + f", c AS (SELECT date, big, {_CV} FROM p GROUP BY date, big) SELECT big::BIGINT AS big, {_CS} FROM c GROUP BY big")(lambda s, d: out(A.coverage_summary(A.coverage(signal_panel(s, d), M, "forward_return_1d", "big"), ("big",))))

# Portfolio construction.
W = "portfolio_weight"
_TOP = SQL + ", t AS (SELECT *, CASE WHEN m2 IS NOT NULL THEN row_number() OVER (PARTITION BY date, m2 IS NULL ORDER BY m2 DESC, symbol) END AS k, count(m2) OVER (PARTITION BY date) AS n FROM p), "
_LO = _TOP + "w AS (SELECT *, CASE WHEN k <= 10 THEN (m2 - min(m2) FILTER (WHERE k <= 10) OVER (PARTITION BY date) + 1) END AS s FROM t), lw AS (SELECT *, CASE WHEN k <= 10 THEN s / sum(s) OVER (PARTITION BY date) ELSE 0 END AS weight FROM w)"
query("weights_long_only", _LO + f" SELECT date, symbol, {r('weight', W)} FROM lw")(lambda s, d: out(P.long_only(signal_panel(s, d), M, 10, "score"), "date", "symbol", W))
_LS = _TOP + """u AS (SELECT *, n >= 13 AND k <= 8 AS lg FROM t), v AS (SELECT *, CASE WHEN m2 IS NOT NULL AND NOT coalesce(lg, false) THEN row_number() OVER (PARTITION BY date, m2 IS NOT NULL AND NOT coalesce(lg, false) ORDER BY m2, symbol) END AS j FROM u),
z AS (SELECT date, symbol, ret, CASE WHEN n >= 13 AND k <= 8 THEN 1.0 / 8 WHEN n >= 13 AND j <= 5 THEN -1.0 / 5 ELSE 0 END AS weight FROM v)"""
query("weights_long_short", _LS + f" SELECT date, symbol, {r('weight', W)} FROM z")(lambda s, d: out(P.long_short(signal_panel(s, d), M, 8, 5), "date", "symbol", W))
_WF = _TOP + """w AS (SELECT *, m2 - min(m2) OVER (PARTITION BY date) + 1 AS s FROM t WHERE k <= 14),
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY 0.08 / s, symbol) AS i, 0.08 / s AS cs, (1 - coalesce(sum(0.08::DOUBLE) OVER (PARTITION BY date ORDER BY 0.08 / s, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(s) OVER (PARTITION BY date ORDER BY 0.08 / s, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w),
fl AS (SELECT date, arg_min(lam, i) AS lam FROM o WHERE lam <= cs GROUP BY date)"""
query("waterfill", _WF + f" SELECT p.date, p.symbol, {r('CASE WHEN o.s IS NULL THEN 0 WHEN fl.lam IS NULL THEN 0.08 ELSE least(0.08, greatest(fl.lam, 0) * o.s) END', W)} FROM p LEFT JOIN o ON p.date = o.date AND p.symbol = o.symbol LEFT JOIN fl ON p.date = fl.date")(lambda s, d: out(P.long_only(signal_panel(s, d), M, 14, "score", max_weight=0.08), "date", "symbol", W))
query("group_cap", _LO + f" SELECT date, symbol, {r('weight * CASE WHEN sum(weight) OVER (PARTITION BY date, big) > 0.4 THEN 0.4 / sum(weight) OVER (PARTITION BY date, big) ELSE 1 END', W)} FROM lw")(lambda s, d: out(P.long_only(signal_panel(s, d), M, 10, "score", group="big", group_cap=0.4), "date", "symbol", W))
_OB = _LO + f", e AS (SELECT *, weight * lv AS e, sum(weight * lv) {_D} - 4.5 AS over_, sum(CASE WHEN weight * lv > 0 THEN weight * lv ELSE 0 END) {_D} AS adding FROM lw)"
query("one_bound", _OB + f" SELECT date, symbol, {r('weight * CASE WHEN over_ > 1e-12 AND e > 0 THEN 1 - least(1, over_ / adding) ELSE 1 END', W)} FROM e")(lambda s, d: out(P.long_only(signal_panel(s, d).withColumn("lv", F.ln("volume")), M, 10, "score", bounds=[P.ExposureBound("lv", maximum=4.5)]), "date", "symbol", W))


def _sweeps(bounds: dict[str, float], rounds: int) -> str:
    """CTEs that shrink what adds to one exposure after the other."""
    steps, last = [], "m0"
    for i in range(rounds):
        for j, (x, most) in enumerate(bounds.items()):
            e = f"SELECT *, weight * {x} AS e, sum(weight * {x}) {_D} - {most} AS ov, sum(CASE WHEN weight * {x} > 0 THEN weight * {x} ELSE 0 END) {_D} AS ad FROM {last}"
            last = f"m{i}_{j}"
            steps.append(f"{last} AS (SELECT date, symbol, lv, lc, weight * CASE WHEN ov > 1e-12 AND e > 0 THEN 1 - least(1, ov / ad) ELSE 1 END AS weight FROM ({e}))")
    return ", ".join(steps), last


_MB, _MB_LAST = _sweeps({"lv": 4.5, "lc": 3.5}, 8)
query("multi_bound", _LO + f", m0 AS (SELECT date, symbol, lv, ln(close) AS lc, weight FROM lw), {_MB} SELECT date, symbol, {r('weight', W)} FROM {_MB_LAST}")(
    lambda s, d: out(P.long_only(signal_panel(s, d).withColumns({"lv": F.ln("volume"), "lc": F.ln("close")}), M, 10, "score", bounds=[P.ExposureBound("lv", maximum=4.5), P.ExposureBound("lc", maximum=3.5)]), "date", "symbol", W)
)

# Backtests.
_BT = _LO + """, x AS (SELECT date, symbol, close, volume, coalesce(ret, 0) AS ret, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY date), 0) AS tgt FROM lw),
{reb}, y AS (SELECT x.*, {flag} AS reb FROM x), ex AS (SELECT *, coalesce(last_value(CASE WHEN reb THEN tgt END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w FROM y),
pv AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY date), 0) AS prev FROM ex),
dl AS (SELECT date, sum(w * ret) AS gross, sum(abs(w - prev)) AS turnover, sum(abs(tgt - prev)) AS target_turnover, sum(abs(w)) AS gross_exposure, count_if(w <> 0)::BIGINT AS holdings, bool_or(reb) AS reb, sum(abs(w - prev) * {cost}) AS cost FROM pv GROUP BY date)"""
_DAILY = _BT.format(reb="nothing AS (SELECT 1)", flag="true", cost="0.0005")
_WEEKLY = _BT.format(reb="wk AS (SELECT min(date) AS date FROM x GROUP BY date_trunc('week', date))", flag="x.date IN (SELECT date FROM wk)", cost="0.0005")
_COSTS = _BT.format(reb="nothing AS (SELECT 1)", flag="true", cost="(0.0002 + 0.0003 + 0.001 * abs(w - prev))")
_SEL = f" SELECT date, reb AS is_rebalance_date, {r('gross', 'gross_return')}, {r('target_turnover', 'target_turnover')}, {r('turnover', 'turnover')}, {r('gross_exposure', 'gross_exposure')}, holdings AS holdings_count, {r('cost', 'transaction_cost')}, {r('gross - cost', 'net_return')}, {r('product(1 + gross - cost) OVER (ORDER BY date)', 'net_nav')} FROM dl"
_COLS = ("date", "is_rebalance_date", "gross_return", "target_turnover", "turnover", "gross_exposure", "holdings_count", "transaction_cost", "net_return", "net_nav")
BASIC = B.BacktestSettings(commission_bps=5)
WEEKLY = B.BacktestSettings(commission_bps=5, rebalance="weekly")
COSTS = B.BacktestSettings(commission_bps=2, slippage_bps=3, market_impact_bps_per_turnover=10)


def book(s, d) -> DataFrame:
    return P.long_only(signal_panel(s, d), M, 10, "score")


def result(s, d, settings=BASIC) -> DataFrame:
    return B.run_backtest(book(s, d), settings)


query("backtest_basic", _DAILY + _SEL)(lambda s, d: out(result(s, d), *_COLS))
query("backtest_weekly", _WEEKLY + _SEL)(lambda s, d: out(result(s, d, WEEKLY), *_COLS))
query("backtest_costs", _COSTS + _SEL)(lambda s, d: out(result(s, d, COSTS), *_COLS))
# Folds as recursive queries: over a symbol's rows, or over dates for all symbols at once.
_REC = _LO.replace("WITH bars", "WITH RECURSIVE bars", 1) + """, x AS (SELECT date, symbol, coalesce(ret, 0) AS ret, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY date), 0)::DOUBLE AS tgt,
  row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, dense_rank() OVER (ORDER BY date) AS k FROM lw), """
_END = """, dl AS (SELECT date, true AS reb, sum(w * ret) AS gross, sum(abs(w - prev)) AS turnover, sum(abs(tgt - prev)) AS target_turnover, sum(abs(w)) AS gross_exposure, count_if(w <> 0)::BIGINT AS holdings, sum(abs(w - prev) * 0.0005) AS cost FROM pv GROUP BY date)"""
_CLIP = "greatest(-0.05, least(0.05, x.tgt - st.w))"
_LIMITED = _REC + f"""st AS (SELECT symbol, 0::BIGINT AS i, 0::DOUBLE AS w, 0::DOUBLE AS prev FROM x WHERE i = 1
  UNION ALL SELECT x.symbol, x.i, st.w + CASE WHEN abs({_CLIP}) < 0.005 THEN 0 ELSE {_CLIP} END, st.w FROM st JOIN x ON x.symbol = st.symbol AND x.i = st.i + 1),
pv AS (SELECT x.*, st.w, st.prev FROM x JOIN st USING (symbol, i))""" + _END
_TOTAL = "sum(abs(x.tgt - st.w)) OVER ()"
_CAPPED = _REC + f"""st AS (SELECT symbol, 0::BIGINT AS k, 0::DOUBLE AS w, 0::DOUBLE AS prev FROM x WHERE i = 1
  UNION ALL SELECT st.symbol, st.k + 1, st.w + coalesce((x.tgt - st.w) * CASE WHEN {_TOTAL} > 0.5 THEN 0.5 / {_TOTAL} ELSE 1 END, 0), st.w FROM st LEFT JOIN x ON x.symbol = st.symbol AND x.k = st.k + 1 WHERE st.k < (SELECT max(k) FROM x)),
pv AS (SELECT x.*, st.w, st.prev FROM x JOIN st USING (symbol, k))""" + _END
LIMITED = B.BacktestSettings(commission_bps=5, max_trade_weight=0.05, min_trade_weight=0.005)
CAPPED = B.BacktestSettings(commission_bps=5, max_turnover=0.5)
query("backtest_symbol_limits", _LIMITED + _SEL)(lambda s, d: out(result(s, d, LIMITED), *_COLS))
query("backtest_turnover_cap", _CAPPED + _SEL)(lambda s, d: out(result(s, d, CAPPED), *_COLS))
_EXEC = _CAPPED + ", ct AS (SELECT *, count(CASE WHEN abs(turnover - target_turnover) > 1e-12 THEN 1 END) OVER () AS limited FROM dl)"
query("execution_summary", _EXEC + f""" SELECT count(*) AS periods, count_if(reb)::BIGINT AS rebalance_dates, any_value(limited) AS turnover_limit_dates, {r('avg(target_turnover)', 'average_target_turnover')}, {r('avg(turnover)', 'average_realized_turnover')},
{r('avg(gross_exposure)', 'average_gross_exposure')}, {r('avg(holdings)', 'average_realized_holdings')}, {r('sum(cost)', 'total_commission_cost')}, {r('sum(cost)', 'total_transaction_cost')} FROM ct""")(
    lambda s, d: out(A.execution_summary(result(s, d, CAPPED)), "periods", "rebalance_dates", "turnover_limit_dates", "average_target_turnover", "average_realized_turnover", "average_gross_exposure", "average_realized_holdings", "total_commission_cost", "total_transaction_cost")
)
_ORD = _DAILY + f" SELECT date, symbol, CASE WHEN tgt > prev THEN 'buy' WHEN tgt < prev THEN 'sell' ELSE 'hold' END AS side, {r('prev', 'start_weight')}, {r('tgt', 'target_weight')}, {r('tgt - prev', 'desired_trade')}, {r('w - prev', 'executed_trade')}, {r('(tgt - prev) - (w - prev)', 'unfilled_trade')} FROM pv WHERE abs(tgt - prev) > 0.001 OR abs(w - prev) > 0.001"
query("orders", _ORD)(lambda s, d: out(B.orders(B.backtest_panel(book(s, d), BASIC), 0.001)))
query("ledger", _DAILY + f" SELECT date, symbol, CASE WHEN w > 0 THEN 'long' WHEN w < 0 THEN 'short' ELSE 'flat' END AS position_side, {r('prev', 'start_weight')}, {r('w', 'end_weight')}, {r('w * ret', 'gross_return_contribution')} FROM pv WHERE abs(prev) > 0 OR abs(w) > 0")(lambda s, d: out(B.ledger(B.backtest_panel(book(s, d), BASIC)), "date", "symbol", "position_side", "start_weight", "end_weight", "gross_return_contribution"))

# Performance and risk.
_NAV = _DAILY + ", nv AS (SELECT date, turnover, gross - cost AS x, product(1 + gross - cost) OVER (ORDER BY date) AS nav FROM dl), dd AS (SELECT *, max(nav) OVER (ORDER BY date) AS peak, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM nv)"
query("drawdown", _NAV + f" SELECT date, {r('nav', 'nav')}, {r('peak', 'running_max')}, {r('drawdown', 'drawdown')} FROM dd")(lambda s, d: out(A.drawdowns(result(s, d))))
_PERF = f"count(*) AS periods, {r('product(1 + x) - 1', 'cumulative_return')}, {r('power(product(1 + x), 252.0 / count(*)) - 1', 'annualized_return')}, {r('stddev_samp(x) * sqrt(252)', 'annualized_volatility')}, {r('avg(x) / nullif(stddev_samp(x), 0) * sqrt(252)', 'sharpe_ratio')}, {r('avg(turnover)', 'average_turnover')}, {r('sum(turnover)', 'total_turnover')}, {r('avg((x > 0)::INT)', 'hit_rate')}, {r('min(drawdown)', 'max_drawdown')}"
query("perf_summary", _NAV + f" SELECT {_PERF} FROM dd")(lambda s, d: out(A.performance(result(s, d))))


_REL = _NAV + ", rl AS (SELECT nv.*, bench.b FROM nv JOIN bench USING (date))"
_attached = lambda s, d: B.attach_benchmark(result(s, d), S.benchmark_returns(panel(s, d)))
_AN = lambda x: f"power(product(1 + {x}), 252.0 / count(*)) - 1"
query("relative_perf", _REL + f""" SELECT count(*) AS periods, {r('product(1 + b) - 1', 'benchmark_cumulative_return')}, {r(_AN('b'), 'benchmark_annualized_return')}, {r('product(1 + x) / product(1 + b) - 1', 'excess_cumulative_return')},
{r('power(product(1 + x) / product(1 + b), 252.0 / count(*)) - 1', 'annualized_excess_return')}, {r('avg(x - b)', 'average_daily_excess_return')}, {r('stddev_samp(x - b) * sqrt(252)', 'tracking_error')}, {r('avg(x - b) / nullif(stddev_samp(x - b), 0) * sqrt(252)', 'information_ratio')}, {r('avg((x > b)::INT)', 'excess_hit_rate')} FROM rl""")(
    lambda s, d: out(A.relative_performance(_attached(s, d)))
)
query("benchmark_attach", _REL + f" SELECT date, {r('x - b', 'excess_return')}, {r('(1 + x) / (1 + b) - 1', 'relative_return')} FROM rl")(lambda s, d: out(_attached(s, d), "date", "excess_return", "relative_return"))
query("risk_summary", _NAV + f", ex2 AS (SELECT date, sum(abs(w)) AS ge, sum(w) AS ne FROM pv GROUP BY date), q AS (SELECT nv.*, ge, ne, quantile_cont(x, 0.05) OVER () AS v FROM nv JOIN ex2 USING (date)) SELECT count(*) AS periods, {r('stddev_samp(x) * sqrt(252)', 'realized_volatility')}, {r('sqrt(avg(least(x, 0) ** 2)) * sqrt(252)', 'downside_volatility')}, {r('any_value(v)', 'value_at_risk')}, {r('avg(CASE WHEN x <= v THEN x END)', 'conditional_value_at_risk')}, {r('0.95::DOUBLE', 'var_confidence')}, {r('avg(ge)', 'average_gross_exposure')}, {r('avg(ne)', 'average_net_exposure')} FROM q")(lambda s, d: out(A.risk(result(s, d))))
_RB = _REL + f", rb AS (SELECT date, CASE WHEN count(x) {_W5} = 5 THEN covar_samp(x, b) {_W5} / nullif(var_samp(b) {_W5}, 0) END AS rolling_beta, CASE WHEN count(x) {_W5} = 5 THEN covar_samp(x, b) {_W5} / nullif(sqrt(var_samp(b) {_W5}), 0) / nullif(sqrt(var_samp(x) {_W5}), 0) END AS rolling_correlation FROM rl)"
query("rolling_benchmark_risk", _RB + f" SELECT date, {r('rolling_beta', 'rolling_beta')}, {r('rolling_correlation', 'rolling_correlation')} FROM rb")(lambda s, d: out(A.rolling_benchmark_risk(_attached(s, d), 5)))
query("rolling_benchmark_summary", _RB + f" SELECT {r('avg(rolling_beta)', 'average_beta')}, {r('avg(rolling_correlation)', 'average_correlation')}, {r('arg_max(rolling_beta, date) FILTER (WHERE rolling_beta IS NOT NULL AND rolling_correlation IS NOT NULL)', 'latest_beta')}, {r('arg_max(rolling_correlation, date) FILTER (WHERE rolling_beta IS NOT NULL AND rolling_correlation IS NOT NULL)', 'latest_correlation')} FROM rb")(lambda s, d: out(A.rolling_benchmark_risk_summary(A.rolling_benchmark_risk(_attached(s, d), 5))))
_PROF = _LS + """, rk AS (SELECT date, symbol, weight, abs(weight) AS a, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, symbol) AS k FROM z),
pf0 AS (SELECT date, sum(a) AS gross, sum(weight) AS net, CASE WHEN sum(a) > 0 THEN sum(a * a) / sum(a) / sum(a) ELSE 0 END AS hhi, max(a) AS largest, CASE WHEN sum(a) > 0 THEN max(a) / sum(a) ELSE 0 END AS top1, CASE WHEN sum(a) > 0 THEN sum(CASE WHEN k <= 5 THEN a ELSE 0 END) / sum(a) ELSE 0 END AS top5,
  count_if(a > 1e-12)::BIGINT AS held, count_if(weight > 1e-12)::BIGINT AS longs, count_if(weight < -1e-12)::BIGINT AS shorts FROM rk GROUP BY date),
pf AS (SELECT *, CASE WHEN hhi > 0 THEN 1 / hhi ELSE 0 END AS eff, CASE WHEN hhi > 0 THEN 1 / hhi / held ELSE 0 END AS share FROM pf0)"""
_ls = lambda s, d: P.long_short(signal_panel(s, d), M, 8, 5)
query("concentration", _PROF + f" SELECT count(*) AS periods, {r('avg(gross)', 'average_gross_exposure')}, {r('max(gross)', 'max_gross_exposure')}, {r('avg(net)', 'average_net_exposure')}, {r('avg(hhi)', 'average_herfindahl_index')}, {r('avg(largest)', 'average_max_abs_weight')} FROM pf")(lambda s, d: out(A.concentration(_ls(s, d), W)))
query("diversification", _PROF + f""" SELECT count(*) AS periods, {r('avg(held)', 'average_holdings_count')}, min(held) AS min_holdings_count, {r('avg(longs)', 'average_long_count')}, {r('avg(shorts)', 'average_short_count')}, {r('avg(eff)', 'average_effective_number_of_positions')}, {r('min(eff)', 'min_effective_number_of_positions')},
{r('avg(share)', 'average_effective_position_ratio')}, {r('min(share)', 'min_effective_position_ratio')}, {r('avg(top1)', 'average_top_position_weight_share')}, {r('max(top1)', 'max_top_position_weight_share')}, {r('avg(top5)', 'average_top_five_weight_share')}, {r('max(top5)', 'max_top_five_weight_share')} FROM pf""")(
    lambda s, d: out(A.diversification(_ls(s, d), W))
)
query("group_exposure", _LS + f""", ge AS (SELECT date, CASE WHEN symbol < '5' THEN 'low' ELSE '<missing>' END AS group_value, sum(abs(weight)) AS gross, sum(weight) AS net, count_if(abs(weight) > 1e-12)::BIGINT AS held FROM z GROUP BY 1, 2)
SELECT 'sector' AS group_column, group_value, group_value = '<missing>' AS is_missing_group, count(*) AS periods, {r('avg(gross)', 'average_gross_exposure')}, {r('max(gross)', 'max_gross_exposure')}, {r('avg(net)', 'average_net_exposure')}, {r('max(abs(net))', 'max_abs_net_exposure')}, {r('avg(held)', 'average_holdings_count')}, max(held) AS max_holdings_count FROM ge GROUP BY group_value""")(
    lambda s, d: out(A.group_exposure(_ls(s, d).withColumn("sector", F.when(F.col("symbol") < "5", "low").otherwise(" ")), W, "sector"))
)
_NE = _LS + """, ne AS (SELECT z.date, abs(z.weight) AS a, z.weight AS w, e.k AS exposure_column, CASE e.k WHEN 'lv' THEN p.lv WHEN 'half' THEN CASE WHEN p.symbol < '5' THEN p.close END END AS x FROM z JOIN p ON z.date = p.date AND z.symbol = p.symbol, (VALUES ('lv'), ('half')) e(k)),
nd0 AS (SELECT exposure_column, date, coalesce(sum(a * x) FILTER (WHERE a > 1e-12 AND x IS NOT NULL), 0) AS ax, coalesce(sum(w * x) FILTER (WHERE a > 1e-12 AND x IS NOT NULL), 0) AS nx, coalesce(sum(a) FILTER (WHERE a > 1e-12 AND x IS NOT NULL), 0) AS yes, coalesce(sum(a) FILTER (WHERE a > 1e-12 AND x IS NULL), 0) AS nope,
  count_if(a > 1e-12)::BIGINT AS n, count_if(a > 1e-12 AND x IS NOT NULL)::BIGINT AS ny, count_if(a > 1e-12 AND x IS NULL)::BIGINT AS nn FROM ne GROUP BY 1, 2),
nd AS (SELECT *, CASE WHEN yes > 1e-12 THEN ax / yes END AS m, CASE WHEN yes > 1e-12 THEN nx END AS net FROM nd0)"""
query("numeric_exposure", _NE + f""" SELECT exposure_column, count(*) AS periods, {r('avg(m)', 'average_absolute_weighted_exposure')}, {r('arg_max(m, date) FILTER (WHERE m IS NOT NULL)', 'latest_absolute_weighted_exposure')}, {r('avg(net)', 'average_net_weighted_exposure')}, {r('arg_max(net, date) FILTER (WHERE m IS NOT NULL)', 'latest_net_weighted_exposure')},
{r('avg(yes)', 'average_gross_weight_with_exposure')}, {r('avg(nope)', 'average_gross_weight_missing_exposure')}, {r('avg(n)', 'average_active_positions')}, {r('avg(ny)', 'average_positions_with_exposure')}, {r('avg(nn)', 'average_missing_exposure_positions')} FROM nd GROUP BY exposure_column""")(
    lambda s, d: out(A.numeric_exposure(_ls(s, d).withColumns({"lv": F.ln("volume"), "half": F.when(F.col("symbol") < "5", F.col("close"))}), W, ["lv", "half"]))
)
query("shares_summary", _EV + f" SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(eff) AS start_date, max(eff) AS end_date, {r('(SELECT sum(x) FROM (SELECT arg_max(1000 + value, eff) AS x FROM ev GROUP BY symbol))', 'latest_shares_total')} FROM ev")(
    lambda s, d: out(A.source_summary(_records(s, d).select("symbol", "effective_date", (F.lit(1000) + F.col("value")).alias("shares_outstanding")), "shares_outstanding"))
)
query("market_summary", SQL + "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date FROM bars")(lambda s, d: out(A.market_summary(S.bars(s, d))))
query("quality_summary", SQL + f", a AS (SELECT count(*) AS n FROM bars GROUP BY symbol), c AS (SELECT count(*) AS n FROM bars GROUP BY date) SELECT (SELECT min(n) FROM a) AS min_rows_per_symbol, {r('(SELECT avg(n) FROM a)', 'avg_rows_per_symbol')}, (SELECT max(n) FROM a) AS max_rows_per_symbol, (SELECT min(n) FROM c) AS min_symbols_per_date, {r('(SELECT avg(n) FROM c)', 'avg_symbols_per_date')}, (SELECT max(n) FROM c) AS max_symbols_per_date")(lambda s, d: out(A.quality_summary(S.bars(s, d))))

# Experiments: one long table of candidates under their lookback.
_RUNS = SQL + ", cd AS (" + " UNION ALL ".join(f"SELECT {v}::BIGINT AS v, date, symbol, ret, f1, close / lag(close, {v}) OVER (PARTITION BY symbol ORDER BY date) - 1 AS m FROM p" for v in (1, 2, 3)) + """),
pk AS (SELECT *, CASE WHEN m IS NOT NULL THEN row_number() OVER (PARTITION BY v, date, m IS NULL ORDER BY m DESC, symbol) END AS k FROM cd),
wt AS (SELECT *, CASE WHEN k <= 10 THEN 1.0 / count(CASE WHEN k <= 10 THEN 1 END) OVER (PARTITION BY v, date) ELSE 0 END AS weight FROM pk),
wx AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY v, symbol ORDER BY date), 0) AS w FROM wt), wp AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY v, symbol ORDER BY date), 0) AS prev FROM wx),
rd AS (SELECT v, date, sum(w * coalesce(ret, 0)) - sum(abs(w - prev) * 0.0005) AS x, sum(abs(w - prev)) AS turnover, count(*) AS total, count(CASE WHEN m IS NOT NULL THEN f1 END) AS usable,
  CASE WHEN count(CASE WHEN m IS NOT NULL THEN f1 END) >= 2 THEN covar_samp(m, f1) / nullif(sqrt(var_samp(CASE WHEN f1 IS NOT NULL THEN m END)), 0) / nullif(sqrt(var_samp(CASE WHEN m IS NOT NULL THEN f1 END)), 0) END AS ic FROM wp GROUP BY v, date)"""
query("sweep", _RUNS + f""", nv AS (SELECT *, product(1 + x) OVER (PARTITION BY v ORDER BY date) AS nav FROM rd), dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY v ORDER BY date) - 1 AS dd FROM nv)
SELECT 'lookback' AS parameter_name, v AS parameter_value, 'momentum_signal_' || v || 'd' AS signal_column, {r('product(1 + x) - 1', 'cumulative_return')}, {r('min(dd)', 'max_drawdown')}, {r('avg(x) / nullif(stddev_samp(x), 0) * sqrt(252)', 'sharpe_ratio')}, {r('avg(turnover)', 'average_turnover')}, {r('avg((x > 0)::INT)', 'hit_rate')},
{r('avg(ic)', 'mean_ic')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'ic_ir')}, {r('sum(usable) / sum(total)', 'joint_coverage_ratio')}, 'long_only' AS construction FROM dd GROUP BY v""")(
    lambda s, d: out(E.sweep(X.forward_return(panel(s, d), 1), "momentum", "lookback", [1, 2, 3], BASIC, 10))
)
_FOLDS = _RUNS + """, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)),
fo AS (SELECT f.k + 1 AS fold_index, dn.date, CASE WHEN dn.i < f.k * 4 + 8 THEN 'train' ELSE 'test' END AS role FROM dn, (SELECT unnest(range(0, 1000)) AS k) f WHERE f.k * 4 + 12 <= dn.n AND dn.i >= f.k * 4 AND dn.i < f.k * 4 + 12),
fv AS (SELECT rd.*, fold_index, role, product(1 + x) OVER (PARTITION BY fold_index, role, v ORDER BY rd.date) AS nav FROM rd JOIN fo ON rd.date = fo.date),
fd AS (SELECT *, nav / max(nav) OVER (PARTITION BY fold_index, role, v ORDER BY date) - 1 AS dd FROM fv),
sc AS (SELECT fold_index, role, v, product(1 + x) - 1 AS cum, min(dd) AS low, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252) AS sharpe, avg(ic) AS ic, sum(usable) / sum(total) AS joint, min(date) AS a, max(date) AS b FROM fd GROUP BY 1, 2, 3),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_index ORDER BY cum DESC NULLS LAST, v) AS o FROM sc WHERE role = 'train') WHERE o = 1)"""
query("walk_forward", _FOLDS + f""" SELECT bs.fold_index, 'lookback' AS parameter_name, bs.v AS selected_parameter_value, 'momentum_signal_' || bs.v || 'd' AS signal_column, 'cumulative_return' AS selection_metric, bs.a AS train_start, bs.b AS train_end, t.a AS test_start, t.b AS test_end, {r('bs.cum', 'train_selection_score')}, {r('bs.cum', 'train_cumulative_return')}, {r('bs.ic', 'train_mean_ic')},
{r('t.cum', 'test_cumulative_return')}, {r('t.low', 'test_max_drawdown')}, {r('t.sharpe', 'test_sharpe_ratio')}, {r('t.ic', 'test_mean_ic')}, {r('t.joint', 'test_joint_coverage_ratio')} FROM bs JOIN sc t ON t.fold_index = bs.fold_index AND t.v = bs.v AND t.role = 'test'""")(
    lambda s, d: out(E.walk_forward(X.forward_return(panel(s, d), 1), "momentum", "lookback", [1, 2, 3], BASIC, 10, 8, 4))
)
