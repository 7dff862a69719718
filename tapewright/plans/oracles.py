"""The SQL that says the same as the registered queries, for a check by another engine.

Exponential averages are written as sums with closed-form weights, so none of it needs recursion.
"""

from __future__ import annotations

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price, COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS size FROM events WHERE value > 0)"""
_UNITS = {"15m": "15 minutes", "1h": "1 hour", "2h": "2 hours", "4h": "4 hours", "6h": "6 hours", "12h": "12 hours", "1d": "1 day", "3d": "3 days"}
EPOCH = "TIMESTAMP '1970-01-01'"
OHLCV = 'open, high, low, close, volume'


def bars(width: str, name: str = "bars", source: str = "ticks") -> str:
    """A CTE of bars of one width from ticks."""
    return f"""{name} AS (SELECT symbol, '{width}' AS "interval", time_bucket(INTERVAL '{_UNITS[width]}', ts, {EPOCH}) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume FROM {source} GROUP BY ALL)"""


def wider(width: str, name: str, source: str) -> str:
    return f"""{name} AS (SELECT symbol, '{width}' AS "interval", time_bucket(INTERVAL '{_UNITS[width]}', ts, {EPOCH}) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM {source} GROUP BY ALL)"""


def rounded(names: str) -> str:
    return ", ".join(f'round("{n.strip()}", 6) AS "{n.strip()}"' for n in names.split(","))


def bar_query(ctes: str, source: str) -> str:
    return f"""WITH {ctes} SELECT symbol, "interval", ts, {rounded(OHLCV)} FROM {source}"""


def _w(n: int | None = None) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY ts{frame})"


def _full(expr: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN {expr} END"


def _average(name: str, source: str, x: str, alpha: str, first: int, n: int, divisor: int | None = None) -> str:
    """A CTE (symbol, rn, name): an exponential average seeded with the mean of n values from row `first` on."""
    seed = first + n - 1
    weight = f"CASE WHEN j.rn <= {seed} THEN pow(1 - {alpha}, t.rn - {seed}) / {divisor or n} ELSE {alpha} * pow(1 - {alpha}, t.rn - j.rn) END"
    return f"{name} AS (SELECT t.symbol, t.rn, sum(({weight}) * j.{x}) AS {name} FROM {source} t JOIN {source} j ON j.symbol = t.symbol AND j.rn BETWEEN {first} AND t.rn WHERE t.rn >= {seed} GROUP BY ALL)"


def _weighted(name: str, source: str, x: str, alpha: str, first: int) -> str:
    """A CTE (symbol, rn, name): the mean with finite exponential weights from row `first` on."""
    w = f"pow(1 - {alpha}, t.rn - j.rn)"
    return f"{name} AS (SELECT t.symbol, t.rn, sum({w} * j.{x}) / sum({w}) AS {name} FROM {source} t JOIN {source} j ON j.symbol = t.symbol AND j.rn BETWEEN {first} AND t.rn WHERE t.rn >= {first} GROUP BY ALL)"


_RANGE = "max(high) {w} - min(low) {w}".replace("{w}", _w(14))
SERIES = ",\n".join(
    [
        TICKS,
        bars("4h"),
        f"""b0 AS (SELECT *, row_number() {_w()} AS rn, lag(close) {_w()} AS pc, lag(low) {_w()} AS pl, lag(high) {_w()} AS ph, (high + low + close) / 3 AS tp FROM bars)""",
        f"""b1 AS (SELECT *, coalesce(close - pc, 0) AS d, lag(tp) {_w()} AS ptp, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, abs(high - pl) AS vp, abs(low - ph) AS vm,
  CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS mfv, CASE WHEN close > open THEN volume WHEN close < open THEN -volume ELSE 0 END AS delta,
  CASE WHEN pc IS NULL OR close >= pc THEN volume ELSE -volume END AS ostep, CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS zstep,
  CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS nvr,
  CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm FROM b0)""",
        f"""b2 AS (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS inflow, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS outflow,
  sum(nvr) {_w(12)} AS nv, list(tp) {_w(9)} AS tps, avg(tp) {_w(9)} AS tpm, sum(mfv) {_w()} AS flow,
  {_full("close - (max(high) {w} + min(low) {w}) / 2".replace("{w}", _w(14)), 14)} AS mid, {_full(_RANGE, 14)} AS spread FROM b1)""",
        _average("ema3", "b2", "close", "0.5", 1, 3),
        _average("ema8", "b2", "close", "(2.0 / 9)", 1, 8),
        _average("gains", "b2", "gain", "(1.0 / 14)", 2, 14),
        _average("losses", "b2", "loss", "(1.0 / 14)", 2, 14),
        _average("fast", "b2", "close", "(2.0 / 25)", 1, 1),
        _average("slow", "b2", "close", "(2.0 / 53)", 1, 1),
        "line AS (SELECT fast.symbol, fast.rn, fast - slow AS line FROM fast JOIN slow USING (symbol, rn) WHERE rn >= 52)",
        _average("sign", "line", "line", "(2.0 / 19)", 52, 1),
        _average("wtr", "b2", "tr", "(1.0 / 14)", 2, 13, 14),
        _average("wpdm", "b2", "pdm", "(1.0 / 14)", 2, 13, 14),
        _average("wmdm", "b2", "mdm", "(1.0 / 14)", 2, 13, 14),
        "di AS (SELECT symbol, rn, 100 * wpdm / wtr AS plus_di, 100 * wmdm / wtr AS minus_di, CASE WHEN wpdm + wmdm = 0 THEN 0 ELSE 100 * abs(wpdm - wmdm) / (wpdm + wmdm) END AS dx FROM wtr JOIN wpdm USING (symbol, rn) JOIN wmdm USING (symbol, rn) WHERE rn >= 15)",
        _average("adx", "di", "dx", "(1.0 / 14)", 15, 14),
        _average("flow3", "b2", "flow", "0.5", 1, 1),
        _average("flow10", "b2", "flow", "(2.0 / 11)", 1, 1),
        _weighted("mid1", "b2", "mid", "0.5", 14),
        _weighted("mid2", "mid1", "mid1", "0.5", 14),
        _weighted("spread1", "b2", "spread", "0.5", 14),
        _weighted("spread2", "spread1", "spread1", "0.5", 14),
        "smi0 AS (SELECT b2.symbol, b2.rn, coalesce(100 * mid2 / (spread2 / 2), 0) AS smi FROM b2 LEFT JOIN mid2 USING (symbol, rn) LEFT JOIN spread2 USING (symbol, rn))",
        _weighted("smisig", "smi0", "smi", "0.5", 1),
        f"""joined AS (SELECT b2.*, ema3, ema8, gains, losses, line, sign, plus_di, minus_di, adx, flow3, flow10, smi, smisig FROM b2 LEFT JOIN ema3 USING (symbol, rn) LEFT JOIN ema8 USING (symbol, rn) LEFT JOIN gains USING (symbol, rn)
  LEFT JOIN losses USING (symbol, rn) LEFT JOIN line USING (symbol, rn) LEFT JOIN sign USING (symbol, rn) LEFT JOIN di USING (symbol, rn) LEFT JOIN adx USING (symbol, rn) LEFT JOIN flow3 USING (symbol, rn) LEFT JOIN flow10 USING (symbol, rn) LEFT JOIN smi0 USING (symbol, rn) LEFT JOIN smisig USING (symbol, rn))""",
        f"""full0 AS (SELECT symbol, "interval", ts, open, high, low, close, volume, rn,
  {_full(f'CASE WHEN sum(inflow) {_w(14)} + sum(outflow) {_w(14)} < 1 THEN 0 ELSE 100 * sum(inflow) {_w(14)} / (sum(inflow) {_w(14)} + sum(outflow) {_w(14)}) END', 15)} AS "MFI",
  coalesce({_full(f'100 - 100 / (1 + avg(gain) {_w(14)} / CASE WHEN avg(loss) {_w(14)} = 0 THEN 1 ELSE avg(loss) {_w(14)} END)', 14)}, 0) AS "RSM",
  coalesce({_full(f'100 * (sum(gain) {_w(13)} - sum(loss) {_w(13)}) / nullif(sum(gain) {_w(13)} + sum(loss) {_w(13)}, 0)', 13)}, 0) AS "TRP",
  {_full(f'sum(mfv) {_w(20)} / nullif(sum(volume) {_w(20)}, 0)', 20)} AS "CMF",
  {_full('CASE WHEN list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 9 < 1e-12 THEN 0 ELSE (tp - tpm) / (0.015 * list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 9) END', 9)} AS "CCI",
  {_full(f'coalesce(100 * (close - max(high) {_w(14)}) / nullif({_RANGE}, 0), 0)', 14)} AS "WIL",
  {_full(f'100 * (close - min(low) {_w(14)}) / nullif({_RANGE}, 0)', 14)} AS "Stoch_K",
  nvr AS "Net_Volume_Raw", nv AS "Net_Volume", CASE WHEN rn >= 5 THEN coalesce((nv - avg(nv) {_w(100)}) / CASE WHEN stddev_samp(nv) {_w(100)} > 1e-9 THEN stddev_samp(nv) {_w(100)} END, 0) END AS "Net_Volume_Z",
  delta AS "CVD_Delta", sum(delta) {_w()} AS "CVD", sum(delta) {_w(20)} AS "CVD_Mom", {_full(f'sum(delta) {_w(5)}', 6)} AS "CVD_Slope",
  sum(tp * volume) OVER day / nullif(sum(volume) OVER day, 0) AS "VWAP",
  {_full(f'avg(close) {_w(20)}', 20)} AS "SMA_20", {_full(f'avg(close) {_w(50)}', 50)} AS "SMA_50", {_full(f'avg(close) {_w(200)}', 200)} AS "SMA_200",
  {_full(f'avg(close) {_w(20)} + 2 * stddev_samp(close) {_w(20)}', 20)} AS "BB_Upper", {_full(f'avg(close) {_w(20)}', 20)} AS "BB_Middle", {_full(f'avg(close) {_w(20)} - 2 * stddev_samp(close) {_w(20)}', 20)} AS "BB_Lower",
  sum(ostep) {_w()} AS "OBV", sum(zstep) {_w()} AS "OBV_zero",
  {_full(f'sum(vp) {_w(14)} / nullif(sum(CASE WHEN rn > 1 THEN tr END) {_w(14)}, 0)', 15)} AS "VI+", {_full(f'sum(vm) {_w(14)} / nullif(sum(CASE WHEN rn > 1 THEN tr END) {_w(14)}, 0)', 15)} AS "VI-",
  (close - pc) * volume AS "FRC", {_full(f'min(low) {_w(14)}', 14)} AS "SR_SUPPORT", {_full(f'max(high) {_w(14)}', 14)} AS "SR_RESISTANCE", max(high) {_w(100)} AS "Fib_High", min(low) {_w(100)} AS "Fib_Low",
  100 * gains / nullif(gains + losses, 0) AS "RSI", adx AS "ADX", plus_di AS "+DI", minus_di AS "-DI", ema3 AS "EMA_3", ema8 AS "EMA_8", 100 * (ema3 - ema8) / ema8 AS "EMA_Signal", line AS "MCD",
  CASE WHEN rn >= 69 THEN sign END AS "MCD_Signal", CASE WHEN rn >= 69 THEN line - sign END AS "MCD_Hist", smi AS "SMI", smisig AS "SMI_Signal", CASE WHEN rn >= 10 THEN flow3 - flow10 ELSE 0 END AS "ADO"
  FROM joined WINDOW day AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
        f"""series AS (SELECT *, {_full(f'avg("Stoch_K") {_w(3)}', 16)} AS "Stoch_D",
  CASE WHEN "ADX" IS NULL OR "RSI" IS NULL THEN 'NO_SIGNAL' WHEN "ADX" >= 25 AND "+DI" - "-DI" >= 5 AND "RSI" < 65 THEN 'BUY' WHEN "ADX" >= 25 AND "-DI" - "+DI" >= 5 AND "RSI" > 35 THEN 'SELL' ELSE 'WAIT' END AS "COMBINED_TREND_SIGNAL",
  CASE WHEN "SR_SUPPORT" IS NULL OR "SR_RESISTANCE" - "SR_SUPPORT" <= 0 THEN 'neutral' WHEN close >= "SR_RESISTANCE" * 0.997 THEN 'resistance' WHEN close <= "SR_SUPPORT" * 1.003 THEN 'support'
   WHEN "SR_RESISTANCE" - close < close - "SR_SUPPORT" THEN 'near_resistance' ELSE 'near_support' END AS "SR_SIGNAL",
  {", ".join(f'round("Fib_High" - nullif("Fib_High" - "Fib_Low", 0) * {v}, 8) AS "{k}"' for k, v in {"Fib_0": 0.0, "Fib_236": 0.236, "Fib_382": 0.382, "Fib_500": 0.5, "Fib_618": 0.618, "Fib_786": 0.786, "Fib_1000": 1.0}.items())} FROM full0)""",
    ]
)
LATEST = f"""latest AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"""


def series_query(numbers: str, texts: str = "") -> str:
    """The named columns of every bar."""
    names = "".join(f', "{n.strip()}"' for n in texts.split(",") if n.strip())
    return f"""WITH {SERIES} SELECT symbol, "interval", ts, {rounded(numbers)}{names} FROM series"""


def _between(name: str, low: float, high: float, default: float) -> str:
    return f"""CASE WHEN coalesce("{name}", {default}) > {high} THEN 1 WHEN coalesce("{name}", {default}) < {low} THEN -1 ELSE 0 END"""


_VOTES = {
    "RSI": _between("RSI", 45, 55, 50),
    "MFI": _between("MFI", 45, 55, 50),
    "SMI": _between("SMI", -20, 20, 0),
    "CCI": _between("CCI", -100, 100, 0),
    "WIL": _between("WIL", -80, -30, -50),
    "CMF": _between("CMF", -0.05, 0.05, 0),
    "ADO": _between("ADO", 0, 0, 0),
    "MCD": _between("MCD_Hist", 0, 0, 0),
    "EMA": _between("EMA_Signal", -0.1, 0.1, 0),
    "OBV": "0",
    "+DI": "0",
    "VOL": """CASE WHEN "Net_Volume_Z" >= 2 THEN 1 WHEN "Net_Volume_Z" <= -2 THEN -1 WHEN "Net_Volume_Z" >= 0.5 THEN 0.5 WHEN "Net_Volume_Z" <= -0.5 THEN -0.5 ELSE 0 END""",
    "CVD": """CASE WHEN "CVD_Mom" > 0 AND "CVD_Slope" > 0 THEN 1 WHEN "CVD_Mom" < 0 AND "CVD_Slope" < 0 THEN -1 WHEN "CVD_Mom" > 0 THEN 0.5 WHEN "CVD_Mom" < 0 THEN -0.5 ELSE 0 END""",
    "VWAP": """CASE WHEN close > "VWAP" * 1.001 THEN 1 WHEN close < "VWAP" * 0.999 THEN -1 ELSE 0 END""",
    "TRD": """CASE "COMBINED_TREND_SIGNAL" WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END""",
    "ADX": """CASE WHEN "ADX" >= 25 AND "+DI" > "-DI" THEN 1 WHEN "ADX" >= 25 AND "-DI" > "+DI" THEN -1 ELSE 0 END""",
}
_WEIGHTS = {"RSI": "1.5", "MFI": "1.5", "SMI": "1.5", "CCI": "1.0", "WIL": "1.0", "CMF": "1.5", "ADO": "1.0", "MCD": "1.5", "EMA": "1.0", "OBV": "0.8", "+DI": "1.0", "VOL": "2.0", "CVD": "1.8", "VWAP": "1.5", "ADX": "1.0"}
_WEIGHTS["TRD"] = """CASE WHEN "ADX" >= 40 AND "COMBINED_TREND_SIGNAL" IN ('BUY', 'SELL') THEN 3.0 ELSE 2.0 END"""


def consensus_query(names: tuple[str, ...]) -> str:
    """The weighted vote of the newest rows."""
    votes = [f"CAST({_VOTES[n]} AS DOUBLE)" for n in names]
    score = " + ".join(f"{v} * CAST({_WEIGHTS[n]} AS DOUBLE)" for v, n in zip(votes, names, strict=True))
    total = " + ".join(f"CAST({_WEIGHTS[n]} AS DOUBLE)" for n in names)
    count = lambda op: " + ".join(f"CAST({v} {op} 0 AS INTEGER)" for v in votes)
    return f"""WITH {SERIES}, {LATEST}, scored AS (SELECT symbol, "interval", ({score}) / ({total}) AS s, {count('>')} AS kns_buy, {count('<')} AS kns_sell, {count('=')} AS kns_neutral FROM latest)
SELECT symbol, "interval", CASE WHEN s >= 0.35 THEN 'STRONG_BUY' WHEN s >= 0.15 THEN 'BUY' WHEN s <= -0.35 THEN 'STRONG_SELL' WHEN s <= -0.15 THEN 'SELL' ELSE 'NEUTRAL' END AS kns_signal,
 round_even(s, 3) AS kns_score, CAST(floor(abs(s) * 100) AS INTEGER) AS kns_strength, kns_buy, kns_sell, kns_neutral FROM scored"""


# --- the composite ------------------------------------------------------------------------------------------------------
def _known(expr: str, n: int, x: str) -> str:
    """A window aggregate of n rows, null unless x is known in all of them."""
    return f"CASE WHEN count({x}) {_w(n)} = n THEN {expr} {_w(n)} END".replace("= n", f"= {n}")


def _roll(x: str, n: int, agg: str = "avg") -> str:
    return _known(f"{agg}({x})", n, x)


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def _carried(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _slope(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN regr_slope({x}, rn) {_w(n)} END"


_BUYS = "('STRONG_BUY', 'BUY', 'WEAK_BUY', 'MOMENTUM_REVERSAL_BUY')"
_SELLS = "('STRONG_SELL', 'SELL', 'WEAK_SELL', 'MOMENTUM_REVERSAL_SELL')"
_MEAN_DEVIATION = "list_sum(list_transform(ctps, lambda x: abs(x - ctpm))) / 14"
#: Needs SERIES. All rows of the 4-hour series are within the composite's window.
TPD = ",\n".join(
    [
        f"""t1 AS (SELECT symbol, "interval", ts, open, high, low, close, volume, rn, "RSI" AS rsi, "MFI" AS mfi, "ADX" AS adx0, "WIL" AS wil, (high + low + close) / 3 AS ctp, list((high + low + close) / 3) {_w(14)} AS ctps, avg((high + low + close) / 3) {_w(14)} AS ctpm,
  {_full("close - (max(high) {w} + min(low) {w}) / 2".replace("{w}", _w(14)), 14)} AS cmid, nullif({_full(_RANGE, 14)}, 0) AS cspread,
  close / lag(close) {_w()} - 1 AS ret, pow(ln(high / low), 2) AS hl2, pow(ln(close / open), 2) AS co2 FROM series)""",
        f"""t2 AS (SELECT *, 0.5 * hl2 - (2 * ln(2) - 1) * co2 AS gk, CASE WHEN rn >= 14 THEN CASE WHEN {_MEAN_DEVIATION} < 1e-12 THEN 0 ELSE (ctp - ctpm) / (0.015 * {_MEAN_DEVIATION}) END END AS cci,
  coalesce(100 * {_roll("cmid", 3)} / ({_roll("cspread", 3)} / 2), 0) AS smi FROM t1)""",
        f"""t3 AS (SELECT *, {_roll("ret", 20, "stddev_samp")} AS vstd, CASE WHEN rn >= 20 THEN sqrt(avg(hl2) {_w(20)}) * sqrt(252) END AS vpark, {_roll("gk", 20)} AS gkm FROM t2)""",
        "t4 AS (SELECT *, CASE WHEN gkm >= 0 THEN sqrt(greatest(gkm, 0)) * sqrt(252) END AS vgk FROM t3)",
        f"""t5 AS (SELECT *, 0.4 * coalesce(vstd / nullif({_roll("vstd", 50)}, 0), 1) + 0.3 * coalesce(vpark / nullif({_roll("vpark", 50)}, 0), 1) + 0.3 * coalesce(vgk / nullif({_roll("vgk", 50)}, 0), 1) AS factor,
  {_carried("rsi")} AS f_rsi, {_carried("mfi")} AS f_mfi, {_carried("cci")} AS f_cci, {_carried("wil")} AS f_wil, {_carried("adx0")} AS f_adx, volume / nullif({_roll("volume", 20)}, 0) AS busy FROM t4)""",
        f"""t6 AS (SELECT *, quantile_cont(factor, 0.7) OVER (PARTITION BY symbol) AS q70, (f_cci - {_roll("f_cci", 100)}) / nullif({_roll("f_cci", 100, "stddev_samp")}, 0) AS z FROM t5)""",
        """t7 AS (SELECT *, 0.25 * CASE WHEN factor > q70 THEN 1.2 ELSE 1 END * CASE WHEN busy > 1.5 THEN 1.1 ELSE 1 END AS w_rsi, 0.25 * CASE WHEN busy > 1.5 THEN 1.15 ELSE 1 END AS w_mfi,
  0.25 * CASE WHEN factor > q70 THEN 1.1 ELSE 1 END AS w_smi, 0.15 * CASE WHEN factor > q70 THEN 1.3 ELSE 1 END AS w_cci, 0.10 AS w_wil FROM t6)""",
        f"""t8 AS (SELECT *, coalesce(((f_rsi - 50) * 2 * w_rsi + (f_mfi - 50) * 2 * w_mfi + ({_clip("smi", -100, 100)}) * w_smi + coalesce({_clip("z * 20", -100, 100)}, 0) * w_cci + (f_wil * 2 + 100) * w_wil) / (w_rsi + w_mfi + w_smi + w_cci + w_wil)
  * (0.5 + 0.5 * ({_clip("f_adx / 50", 0, 1)})) * (1 + 0.3 * (factor - 1)), 0) AS "TPD" FROM t7)""",
        f"""t9 AS (SELECT *, factor AS "TPD_Volatility_Factor", lag("TPD") {_w()} AS tpd1,
  0.3 * CASE WHEN f_adx > 25 THEN 1.0 WHEN f_adx > 15 THEN 0.8 ELSE 0.6 END + 0.3 * CASE WHEN busy > 0.8 THEN 1.0 ELSE 0.7 END + 0.2 * CASE WHEN factor > 1.2 THEN 0.7 WHEN factor > 0.8 THEN 0.9 ELSE 1.0 END
  + 0.2 * abs({" + ".join(f"CASE WHEN {c} > {at} THEN 1 ELSE -1 END" for c, at in (("f_rsi", 50), ("f_mfi", 50), ("smi", 0), ("f_cci", 0), ("f_wil", -50)))}) / 5 AS "TPD_Reliability",
  coalesce(0.5 * ("TPD" - lag("TPD", 3) {_w()}) + 0.3 * ("TPD" - lag("TPD", 5) {_w()}) + 0.2 * ("TPD" - lag("TPD", 10) {_w()}), 0) AS "TPD_Momentum", {_clip("1 + 0.5 * (factor - 1)", 0.5, 1.5)} AS stretch FROM t8)""",
        """t10 AS (SELECT *, "TPD_Reliability" > 0.5 AS hi, "TPD_Reliability" > 0.3 AND "TPD_Reliability" <= 0.5 AS med, 15 * stretch AS lev, 45 * stretch AS strong, "TPD" AS v, "TPD_Momentum" AS m FROM t9)""",
        f"""t11 AS (SELECT *, CASE WHEN v < -strong AND hi AND m < -2 THEN 'STRONG_SELL' WHEN v > strong AND hi AND m > 2 THEN 'STRONG_BUY' WHEN v < -lev AND v >= -strong AND hi AND m < 1 THEN 'SELL' WHEN v > lev AND v <= strong AND hi AND m > -1 THEN 'BUY'
  WHEN v < -lev AND med AND m < 2 THEN 'WEAK_SELL' WHEN v > lev AND med AND m > -2 THEN 'WEAK_BUY' WHEN v > 0 AND m < -3 AND hi AND v < tpd1 THEN 'MOMENTUM_REVERSAL_SELL' WHEN v < 0 AND m > 3 AND hi AND v > tpd1 THEN 'MOMENTUM_REVERSAL_BUY' ELSE 'NEUTRAL' END AS "TPD_Raw_Signal",
  {_slope("close", 10)} AS s_close, {_slope('v', 10)} AS s_tpd, {_slope('v', 3)} AS s3, {_roll("v", 5)} AS m5, {_roll("v", 10)} AS m10, {_roll("v", 20)} AS m20 FROM t10)""",
        """t12 AS (SELECT *, CASE WHEN s_close > 0.001 AND s_tpd < -0.001 THEN 'BEARISH_DIVERGENCE' WHEN s_close < -0.001 AND s_tpd > 0.001 THEN 'BULLISH_DIVERGENCE' WHEN abs(s_close - s_tpd) > 0.002 THEN 'WEAK_DIVERGENCE' ELSE 'NO_DIVERGENCE' END AS "TPD_Divergence" FROM t11)""",
        f"""t13 AS (SELECT *, max(CAST("TPD_Raw_Signal" IN {_SELLS} AS INTEGER)) {_w(3)} = 1 AS any_sell, max(CAST("TPD_Raw_Signal" IN {_BUYS} AS INTEGER)) {_w(3)} = 1 AS any_buy, avg(m) {_w(3)} AS m_mean, m - lag(m, 2) {_w()} AS m_step FROM t12)""",
        """composite AS (SELECT *, CASE WHEN "TPD_Raw_Signal" IN ('BUY', 'STRONG_BUY') AND (any_sell OR NOT coalesce(m_mean > -2 AND m_step > -1, false) OR "TPD_Divergence" = 'BEARISH_DIVERGENCE' OR ("TPD_Divergence" = 'WEAK_DIVERGENCE' AND "TPD_Raw_Signal" = 'STRONG_BUY')) THEN 'WEAK_BUY'
  WHEN "TPD_Raw_Signal" IN ('SELL', 'STRONG_SELL') AND (any_buy OR NOT coalesce(m_mean < 2 AND m_step < 1, false) OR "TPD_Divergence" = 'BULLISH_DIVERGENCE' OR ("TPD_Divergence" = 'WEAK_DIVERGENCE' AND "TPD_Raw_Signal" = 'STRONG_SELL')) THEN 'WEAK_SELL' ELSE "TPD_Raw_Signal" END AS "TPD_Signal",
  CASE WHEN s3 > 0.5 THEN 'UPTREND' WHEN s3 < -0.5 THEN 'DOWNTREND' ELSE 'SIDEWAYS' END AS "TPD_Trend", 0.4 * least(greatest((factor - 1) * 2, 0), 1) + 0.3 * coalesce(CASE WHEN busy IS NOT NULL THEN least(greatest(1 - busy, 0), 1) END, 0.5) + 0.3 * least(abs(m) / 10, 1) AS risk,
  CASE WHEN risk > 0.7 THEN 'HIGH' WHEN risk < 0.3 THEN 'LOW' ELSE 'MEDIUM' END AS "TPD_Risk",
  0.4 * CAST(coalesce(m5 > 0, false) = coalesce(m10 > 0, false) AS INTEGER) + 0.4 * CAST(coalesce(m10 > 0, false) = coalesce(m20 > 0, false) AS INTEGER) + 0.2 * CASE WHEN m5 - m20 IS NOT NULL THEN least(abs(m5 - m20) / 50, 1) END AS "TPD_MTF_Confluence",
  least(greatest(abs(v) / 100 * "TPD_Reliability" * least(greatest(1 / CASE WHEN factor = 0 THEN 1 ELSE factor END, 0.5), 1.2) * (1 + 0.3 * least(abs(m) / 5, 1)), 0), 1) AS "TPD_Strength" FROM t13)""",
    ]
)


def composite_query(numbers: str, texts: str = "") -> str:
    """The named columns of every row of the composite."""
    names = [*([rounded(numbers)] if numbers else []), *(f'"{n.strip()}"' for n in texts.split(",") if n.strip())]
    return f"""WITH {SERIES}, {TPD} SELECT symbol, "interval", ts, {", ".join(names)} FROM composite"""


_CHANGES = """changes AS (SELECT *, CAST(coalesce("TPD_Signal" <> lag("TPD_Signal") OVER (PARTITION BY symbol ORDER BY ts), true) AS INTEGER) AS changed FROM composite)"""
_PARTS = {"TPD": "tpd_score", "TPD_Reliability": "reliability", "TPD_Momentum": "momentum", "TPD_Strength": "signal_strength", "TPD_MTF_Confluence": "confluence", "TPD_Volatility_Factor": "volatility_factor"}
_ANALYSIS = f"""{_CHANGES}, newest AS (SELECT symbol, "interval", "TPD_Signal" AS current_signal, {", ".join(f'round_even("{a}", 2) AS {b}' for a, b in _PARTS.items())}, "TPD_Trend" AS trend, "TPD_Risk" AS risk_level, "TPD_Divergence" AS divergence FROM composite QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
stability AS (SELECT symbol, 1 - sum(changed) / count(*) AS signal_stability FROM changes GROUP BY symbol), late AS (SELECT symbol, "TPD_Signal" AS s FROM composite QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10),
counted AS (SELECT symbol, s, count(*) AS n FROM late GROUP BY ALL), listed AS (SELECT symbol, '{{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}}' AS recent_signals FROM counted GROUP BY symbol),
analysis AS (SELECT * FROM newest JOIN stability USING (symbol) JOIN listed USING (symbol))"""
ANALYSIS_QUERY = f"WITH {SERIES}, {TPD}, {_ANALYSIS} SELECT * FROM analysis"
RECOMMENDATION_QUERY = f"""WITH {SERIES}, {TPD}, {_ANALYSIS}, sided AS (SELECT *, CASE WHEN current_signal IN ('STRONG_BUY', 'BUY') THEN 'BUY' WHEN current_signal IN ('STRONG_SELL', 'SELL') THEN 'SELL' WHEN current_signal IN ('WEAK_BUY', 'WEAK_SELL') THEN 'WAIT' ELSE 'NEUTRAL' END AS side FROM analysis),
acted AS (SELECT *, CASE WHEN reliability < 0.5 THEN 'WAIT' WHEN risk_level = 'HIGH' AND side IN ('BUY', 'SELL') THEN 'CAUTIOUS_' || side ELSE side END AS action FROM sided)
SELECT symbol, "interval", action, CASE WHEN signal_strength > 0.7 AND reliability > 0.7 THEN 'NORMAL' WHEN signal_strength > 0.5 AND reliability > 0.5 THEN 'REDUCED' ELSE 'MINIMAL' END AS position_size, reliability AS confidence,
 CASE WHEN action LIKE '%BUY' OR action LIKE '%SELL' THEN 2 * volatility_factor END AS stop_loss_pct, CASE WHEN action LIKE '%BUY' OR action LIKE '%SELL' THEN 4 * volatility_factor END AS take_profit_pct, risk_level,
 concat_ws(' | ', CASE WHEN current_signal IN ('STRONG_BUY', 'BUY') THEN 'strong buy signal' WHEN current_signal IN ('STRONG_SELL', 'SELL') THEN 'strong sell signal' WHEN current_signal IN ('WEAK_BUY', 'WEAK_SELL') THEN 'weak signal, be careful' END,
  CASE WHEN reliability > 0.7 THEN 'high reliability' WHEN reliability > 0.5 THEN 'medium reliability' ELSE 'low reliability, high risk' END, CASE WHEN abs(momentum) > 3 THEN 'strong momentum' WHEN abs(momentum) > 1 THEN 'medium momentum' ELSE 'weak momentum' END,
  CASE trend WHEN 'UPTREND' THEN 'rising trend' WHEN 'DOWNTREND' THEN 'falling trend' ELSE 'flat trend' END, lower(risk_level) || ' risk', CASE divergence WHEN 'BEARISH_DIVERGENCE' THEN 'bearish divergence' WHEN 'BULLISH_DIVERGENCE' THEN 'bullish divergence' END) AS rationale FROM acted"""
_NULLS = " + ".join(f'sum(CAST("{c}" IS NULL AS INTEGER))' for c in ("TPD", "TPD_Reliability", "TPD_Momentum", "TPD_Volatility_Factor", "TPD_Raw_Signal", "TPD_Divergence", "TPD_Signal", "TPD_Trend", "TPD_Risk", "TPD_MTF_Confluence", "TPD_Strength"))
METRICS_QUERY = f"""WITH {SERIES}, {TPD}, {_CHANGES} SELECT symbol, "interval", sum(changed) AS total_signals, round(avg(changed), 6) AS signal_frequency, round(round_even(avg("TPD_Reliability"), 3), 6) AS avg_reliability, round(round_even(avg("TPD_Strength"), 3), 6) AS avg_signal_strength,
 round(avg(factor), 6) AS volatility_mean, round(stddev_samp(factor), 6) AS volatility_std, round(min(factor), 6) AS volatility_min, round(max(factor), 6) AS volatility_max, count(*) AS total_rows,
 {_NULLS} + sum(CAST(vstd IS NULL AS INTEGER) + CAST(vpark IS NULL AS INTEGER) + CAST(vgk IS NULL AS INTEGER)) AS null_values FROM changes GROUP BY ALL"""
SHARES_QUERY = f"""WITH {SERIES}, {TPD}, counts AS (SELECT symbol, "interval", "TPD_Signal" AS value, count(*) AS n FROM composite GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY symbol, "interval"), 6) AS share FROM counts"""
CONFIRMED_QUERY = f"""WITH {SERIES}, {TPD} SELECT symbol, "interval", ts, "TPD_Raw_Signal", "TPD_Signal", "TPD_Raw_Signal" = "TPD_Signal" AS kept FROM composite WHERE "TPD_Raw_Signal" <> 'NEUTRAL'"""
WEIGHTS_QUERY = f"""WITH {SERIES}, {TPD} SELECT symbol, "interval", ts, {", ".join(f"round(w_{k} / (w_rsi + w_mfi + w_smi + w_cci + w_wil), 6) AS w_{k}" for k in ("rsi", "mfi", "smi", "cci", "wil"))} FROM composite"""


# --- swings and divergence ------------------------------------------------------------------------------------------------
_SIMPLE = (("MFI", "M"), ("RSI", "R"), ("MCD", "M"), ("Net_Volume", "V"), ("CCI", "C"), ("CMF", "C"), ("WIL", "W"), ("+DI", "D"))
_MOVES = ", ".join(f"""CASE WHEN "{c}" > lag("{c}") {_w()} AND close < lag(close) {_w()} THEN -1 WHEN "{c}" < lag("{c}") {_w()} AND close > lag(close) {_w()} THEN 1 ELSE 0 END AS d{i}""" for i, (c, _) in enumerate(_SIMPLE))
_MARKS = ", ".join(f"CASE d{i} WHEN -1 THEN '🔴{m}' WHEN 1 THEN '🟢{m}' END" for i, (_, m) in enumerate(_SIMPLE))
_MOVED = " + ".join(f"d{i}" for i in range(len(_SIMPLE)))
SIMPLE_QUERY = f"""WITH {SERIES}, moves AS (SELECT symbol, "interval", ts, {_MOVES} FROM series)
SELECT symbol, "interval", ts, CASE WHEN {" AND ".join(f"d{i} = 0" for i in range(len(_SIMPLE)))} THEN '➖' ELSE concat_ws('|', {_MARKS}) || '(' || CASE WHEN abs({_MOVED}) >= 3 THEN 'H' WHEN abs({_MOVED}) = 2 THEN 'M' ELSE 'L' END || ')' END AS "DIV" FROM moves"""
_TREND_PARTS = {"TRD_ADX": '"ADX"', "TRD_PLUS_DI": '"+DI"', "TRD_MINUS_DI": '"-DI"', "TRD_RSI": '"RSI"', "COMBINED_TREND": """CASE "COMBINED_TREND_SIGNAL" WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END"""}


def filled_query(columns: list[str]) -> str:
    """Every bar with the named columns, the last known value in place of a null, then 0 for numbers."""
    carried = lambda c: f"last_value({_TREND_PARTS.get(c, f'{chr(34)}{c}{chr(34)}')} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    value = lambda c: carried(c) if c.endswith("SIGNAL") else carried(c) if c == "COMBINED_TREND" else f"round(coalesce({carried(c)}, 0), 6)"
    return f"""WITH {SERIES} SELECT symbol, "interval", ts, {rounded(OHLCV)}, {", ".join(f'{value(c)} AS "{c}"' for c in dict.fromkeys(columns))} FROM series"""


_SWUNG = ("close", "RSI", "MFI", "MCD", "RSM", "SMI")
_N, _APART = 7, 12
_BEYOND = lambda agg, op: f"v {op} {agg}(v) OVER (PARTITION BY symbol, c ORDER BY pos ROWS BETWEEN {_N} PRECEDING AND 1 PRECEDING) AND v {op} {agg}(v) OVER (PARTITION BY symbol, c ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {_N} FOLLOWING)"
#: Needs SERIES, after WITH RECURSIVE.
SWINGS = ",\n".join(
    [
        """recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS len FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 500))""",
        "vals AS (" + " UNION ALL ".join(f"""SELECT symbol, '{c}' AS c, pos, len, "{c}" AS v FROM recent WHERE "{c}" IS NOT NULL""" for c in _SWUNG) + ")",
        f"""marked AS (SELECT *, {_BEYOND("max", ">")} AS hi, {_BEYOND("min", "<")} AS lo, count(*) OVER (PARTITION BY symbol, c) AS known FROM vals)""",
        "points AS (SELECT symbol, c, 'h' AS side, pos, len, v, known FROM marked WHERE hi UNION ALL SELECT symbol, c, 'l', pos, len, v, known FROM marked WHERE lo)",
        f"links AS (SELECT p.symbol, p.c, p.side, p.pos, min(q.pos) AS next FROM points p LEFT JOIN points q ON q.symbol = p.symbol AND q.c = p.c AND q.side = p.side AND q.pos >= p.pos + {_APART} GROUP BY ALL)",
        "kept AS (SELECT symbol, c, side, min(pos) AS pos FROM points GROUP BY ALL UNION ALL SELECT l.symbol, l.c, l.side, l.next AS pos FROM kept k JOIN links l USING (symbol, c, side, pos) WHERE l.next IS NOT NULL)",
        "swung AS (SELECT p.symbol, p.c, p.side, p.pos, p.v, p.known, row_number() OVER (PARTITION BY p.symbol, p.c, p.side ORDER BY p.pos) AS i FROM (SELECT * FROM points JOIN kept USING (symbol, c, side, pos) WHERE pos >= len - 50 QUALIFY row_number() OVER (PARTITION BY symbol, c, side ORDER BY pos DESC) <= 10) p)",
    ]
)
_POINTS = lambda side: f"""'[' || coalesce((SELECT string_agg('{{"pos":' || pos || ',"value":' || v || '}}', ',' ORDER BY pos) FROM swung s WHERE s.symbol = k.symbol AND s.c = 'close' AND side = '{side}'), '') || ']'"""
SWINGS_QUERY = f"""WITH RECURSIVE {SERIES}, {SWINGS}, k AS (SELECT DISTINCT symbol, "interval" FROM series) SELECT symbol, "interval", {_POINTS("h")} AS highs, {_POINTS("l")} AS lows FROM k"""
_NEAR = "(SELECT q.v FROM swung q WHERE q.symbol = a.symbol AND q.c = n.c AND q.side = a.side AND q.known >= 50 AND abs(q.pos - {p}.pos) <= 10 ORDER BY abs(q.pos - {p}.pos), q.pos LIMIT 1)"
_PAIRS = ",\n".join(
    [
        "names AS (SELECT unnest(['RSI', 'MFI', 'MCD', 'RSM', 'SMI']) AS c)",
        f"""paired AS (SELECT a.symbol, n.c AS indicator, a.side, a.i, b.i AS j, a.v AS p1, b.v AS p2, {_NEAR.replace("{p}", "a")} AS q1, {_NEAR.replace("{p}", "b")} AS q2 FROM swung a JOIN swung b ON b.symbol = a.symbol AND b.c = 'close' AND b.side = a.side AND b.i > a.i CROSS JOIN names n WHERE a.c = 'close')""",
        """classed AS (SELECT *, CASE WHEN side = 'l' AND p2 < p1 AND q2 > q1 THEN 'REG_BULLISH' WHEN side = 'l' AND p2 > p1 AND q2 < q1 THEN 'HID_BULLISH' WHEN side = 'h' AND p2 > p1 AND q2 < q1 THEN 'REG_BEARISH' WHEN side = 'h' AND p2 < p1 AND q2 > q1 THEN 'HID_BEARISH' END AS class,
  (abs(p2 - p1) / nullif(abs(p1), 0) + abs(q2 - q1) / nullif(abs(q1), 0)) / 2 AS strength FROM paired)""",
        "best AS (SELECT *, CASE WHEN class LIKE 'REG%' THEN p2 ELSE p1 END AS swing_price FROM classed WHERE class IS NOT NULL AND strength > 0.05 QUALIFY row_number() OVER (PARTITION BY symbol, indicator, class ORDER BY strength DESC, i, j) = 1)",
    ]
)
PAIRS_QUERY = f"""WITH RECURSIVE {SERIES}, {SWINGS}, {_PAIRS} SELECT symbol, '4h' AS "interval", indicator, class, {rounded("p1, p2, q1, q2, strength, swing_price")} FROM best"""
_COUNTS = ", ".join(f"""count(*) FILTER (class = '{c}') AS "DIV_{c}\"""" for c in ("REG_BULLISH", "REG_BEARISH", "HID_BULLISH", "HID_BEARISH"))
_SPAN14 = "OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
_RANGED = f"""ranged AS (SELECT symbol, "interval", pos, len, close, close - lag(close, 2) OVER (PARTITION BY symbol ORDER BY pos) AS change, CASE WHEN pos >= 13 THEN max(close) {_SPAN14} - min(close) {_SPAN14} END AS span FROM recent),
context AS (SELECT * FROM (SELECT *, CASE WHEN count(span) {_SPAN14} = 14 THEN avg(span) {_SPAN14} END AS atr FROM ranged) WHERE pos = len - 1)"""
TRADE_QUERY = f"""WITH RECURSIVE {SERIES}, {SWINGS}, {_PAIRS}, {_RANGED},
stops AS (SELECT c.symbol, c."interval", indicator, class, strength, close, coalesce(atr, 0) AS atr, class LIKE '%BULLISH' AS bull, swing_price + CASE WHEN class LIKE '%BULLISH' THEN -1 ELSE 1 END * coalesce(atr, 0) / 2 AS stop FROM context c JOIN best b USING (symbol)),
targets AS (SELECT *, abs(close - stop) AS risk, abs(close - stop) * CASE WHEN strength > 0.15 THEN 3.0::DOUBLE WHEN strength > 0.10 THEN 2.5 ELSE 2 END AS reward FROM stops)
SELECT symbol, "interval", indicator, class, round(close, 6) AS entry_price, round(stop, 6) AS stop_loss, round(close + CASE WHEN bull THEN reward ELSE -reward END, 6) AS target_price, round(risk, 6) AS risk_amount, round(reward, 6) AS reward_amount, round(CASE WHEN risk > 0 THEN least(greatest(reward / risk, 0.5), 5.0) ELSE 0 END, 6) AS risk_reward, round(atr, 6) AS atr FROM targets"""
DIVERGENCE_QUERY = f"""WITH RECURSIVE {SERIES}, {SWINGS}, {_PAIRS},
ranged AS (SELECT symbol, "interval", pos, len, close, close - lag(close, 2) OVER (PARTITION BY symbol ORDER BY pos) AS change, CASE WHEN pos >= 13 THEN max(close) {_SPAN14} - min(close) {_SPAN14} END AS span FROM recent),
context AS (SELECT * FROM (SELECT *, CASE WHEN count(span) {_SPAN14} = 14 THEN avg(span) {_SPAN14} END AS atr FROM ranged) WHERE pos = len - 1),
stopped AS (SELECT c.symbol, c."interval", b.class, b.strength, class LIKE '%BULLISH' AS bull, coalesce(CASE WHEN class LIKE '%BULLISH' THEN change > 0 ELSE change < 0 END, false) AND class IS NOT NULL AS confirmed,
 abs(c.close - CASE WHEN class LIKE '%BULLISH' THEN swing_price - coalesce(atr, 0) / 2 ELSE swing_price + coalesce(atr, 0) / 2 END) AS risk FROM context c LEFT JOIN best b USING (symbol)),
counted AS (SELECT symbol, "interval", {_COUNTS}, count(*) FILTER (confirmed AND bull) AS confirmed_bullish, count(*) FILTER (confirmed AND NOT bull) AS confirmed_bearish, coalesce(avg(strength), 0) AS avg_strength,
 coalesce(max(CASE WHEN class IS NOT NULL THEN CASE WHEN risk > 0 THEN least(greatest(CASE WHEN strength > 0.15 THEN 3.0 WHEN strength > 0.10 THEN 2.5 ELSE 2.0 END, 0.5), 5.0) ELSE 0 END END), 0) AS max_rr FROM stopped GROUP BY ALL),
judged AS (SELECT *, CASE WHEN confirmed_bearish >= 2 AND 2 * "DIV_REG_BEARISH" + "DIV_HID_BEARISH" >= 3 THEN 'STRONG_BEARISH' WHEN confirmed_bullish >= 2 AND 2 * "DIV_REG_BULLISH" + "DIV_HID_BULLISH" >= 3 THEN 'STRONG_BULLISH'
 WHEN 2 * "DIV_REG_BEARISH" + "DIV_HID_BEARISH" >= 2 THEN 'WEAK_BEARISH' WHEN 2 * "DIV_REG_BULLISH" + "DIV_HID_BULLISH" >= 2 THEN 'WEAK_BULLISH' ELSE 'NEUTRAL' END AS "DIV_CONSENSUS" FROM counted)
SELECT symbol, "interval", "DIV_REG_BULLISH", "DIV_REG_BEARISH", "DIV_HID_BULLISH", "DIV_HID_BEARISH", confirmed_bullish, confirmed_bearish, round(avg_strength, 6) AS avg_strength, round(CAST(max_rr AS DOUBLE), 6) AS max_rr, "DIV_CONSENSUS",
 CASE WHEN "DIV_CONSENSUS" LIKE '%BEARISH' THEN '🔴' WHEN "DIV_CONSENSUS" LIKE '%BULLISH' THEN '🟢' ELSE '⚪' END || CASE WHEN "DIV_REG_BULLISH" + "DIV_REG_BEARISH" + "DIV_HID_BULLISH" + "DIV_HID_BEARISH" = 0 THEN '' ELSE
 '(R(' || "DIV_REG_BEARISH" || '/' || "DIV_REG_BULLISH" || ')H(' || "DIV_HID_BEARISH" || '/' || "DIV_HID_BULLISH" || ')' || CASE WHEN confirmed_bullish + confirmed_bearish > 0 THEN '✓' || (confirmed_bullish + confirmed_bearish) ELSE '' END || CASE WHEN max_rr > 1 THEN printf(' RR:%.1f', max_rr) ELSE '' END || ')' END AS "DIVERGENCE" FROM judged"""
