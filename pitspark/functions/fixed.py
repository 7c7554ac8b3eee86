"""Fixed values the results depend on: schedules, lookup tables, patterns."""

from __future__ import annotations

# Rate-decision days (month, day) per year.
RATE_DECISIONS: dict[int, list[tuple[int, int]]] = {
    2016: [(1, 27), (3, 16), (4, 27), (6, 15), (7, 27), (9, 21), (11, 2), (12, 14)],
    2017: [(2, 1), (3, 15), (5, 3), (6, 14), (7, 26), (9, 20), (11, 1), (12, 13)],
    2018: [(1, 31), (3, 21), (5, 2), (6, 13), (8, 1), (9, 26), (11, 8), (12, 19)],
    2019: [(1, 30), (3, 20), (5, 1), (6, 19), (7, 31), (9, 18), (10, 30), (12, 11)],
    2020: [(1, 29), (3, 3), (3, 15), (3, 18), (4, 29), (6, 10), (7, 29), (9, 16), (11, 5), (12, 16)],
    2021: [(1, 27), (3, 17), (4, 28), (6, 16), (7, 28), (9, 22), (11, 3), (12, 15)],
    2022: [(1, 26), (3, 16), (5, 4), (6, 15), (7, 27), (9, 21), (11, 2), (12, 14)],
    2023: [(2, 1), (3, 22), (5, 3), (6, 14), (7, 26), (9, 20), (11, 1), (12, 13)],
    2024: [(1, 31), (3, 20), (5, 1), (6, 12), (7, 31), (9, 18), (11, 7), (12, 18)],
    2025: [(1, 29), (3, 19), (5, 7), (6, 18), (7, 30), (9, 17), (10, 29), (12, 10)],
    2026: [(1, 28), (3, 18), (4, 29), (6, 17), (7, 29), (9, 16), (10, 28), (12, 16)],
}

# Exchange-local minute of the day at which a series is released.
RELEASE_MINUTE: dict[str, int] = {
    "DGS3MO": 975, "DGS6MO": 975, "DGS2": 975, "DGS5": 975, "DGS10": 975, "DGS30": 975,
    "DFII5": 975, "DFII10": 975, "T5YIE": 975, "T10YIE": 975, "T5YIFR": 975, "DTWEXBGS": 975,
    "VIXCLS": 517, "DCOILBRENTEU": 960, "DCOILWTICO": 960,
    "UNRATE": 510, "PAYEMS": 510, "ICSA": 510, "CCSA": 510, "JTSJOL": 600,
    "CPIAUCSL": 510, "CPILFESL": 510, "PCEPI": 510, "PCEPILFE": 510, "GDPC1": 510,
    "INDPRO": 555, "RSAFS": 510, "HOUST": 510, "UMCSENT": 600, "M2SL": 780, "WALCL": 990,
    "RRPONTSYD": 810, "DFF": 540, "FEDFUNDS": 540, "SOFR": 480,
}

# Exchange-local settlement minute per ticker; everything else settles at 16:00.
SETTLEMENT_MINUTE: dict[str, int] = {"CL=F": 870, "BZ=F": 900}
DEFAULT_SETTLEMENT_MINUTE = 960

# Year-over-year lag in rows by series.
YOY_PERIODS: dict[str, int] = {
    "UNRATE": 12, "PAYEMS": 12, "ICSA": 52, "CCSA": 52, "JTSJOL": 12, "CPIAUCSL": 12,
    "CPILFESL": 12, "PCEPI": 12, "PCEPILFE": 12, "GDPC1": 4, "INDPRO": 12, "RSAFS": 12,
    "HOUST": 12, "UMCSENT": 12, "M2SL": 12, "WALCL": 52, "RRPONTSYD": 260, "DFF": 260,
    "FEDFUNDS": 12,
}

# Theme families of the event log.
THEMES: dict[str, str] = {
    "gold": "WB_2936_GOLD|ECON_GOLDPRICE|WB_2937_SILVER|SLFID_MINERAL_RESOURCES",
    "monetary": "ECON_INTEREST_RATES|ECON_INFLATION|ECON_CENTRALBANK|WB_1235_CENTRAL_BANKS|WB_444_MONETARY_POLICY",
    "conflict": "ARMEDCONFLICT|WB_2433_CONFLICT_AND_VIOLENCE|WB_2432_FRAGILITY_CONFLICT_AND_VIOLENCE"
    "|TERROR|SANCTIONS|TAX_WEAPONS|MARITIME_INCIDENT",
    "stress": "ECON_BANKRUPTCY|ECON_TRADE_DISPUTE|ECON_DEBT",
}

POST_KEYWORDS = ("gold", "GLD", "silver", "SLV", "gdx", "comex", "xau", "bullion", "miner")
POST_FORUMS = ("Gold", "wallstreetbets", "investing", "Goldandsilverstackers", "Commodities")

# Source -> editorial tier; the second table is matched by substring in order.
TIER_EXACT: dict[str, str] = {
    "reuters": "mainstream_neutral", "nasdaq": "mainstream_neutral", "benzinga": "mainstream_neutral",
    "lenta": "mainstream_neutral", "cnnmoney": "mainstream_neutral",
    "marketwatch": "mainstream_neutral", "yahoo": "aggregator_neutral",
}
TIER_EXACT_DEFAULT = "mainstream_neutral"
TIER_SUBSTRING: dict[str, str] = {
    "reuters": "mainstream_neutral", "bloomberg": "mainstream_neutral",
    "benzinga": "mainstream_neutral", "nasdaq": "mainstream_neutral",
    "marketwatch": "mainstream_neutral", "wsj": "mainstream_neutral", "ft": "mainstream_neutral",
    "cnbc": "mainstream_neutral", "seeking_alpha": "retail_pundit",
    "motley_fool": "retail_pundit", "yahoo": "aggregator_neutral",
}
TIER_SUBSTRING_DEFAULT = "aggregator_neutral"

# Feature-name tokens in the order they are tried.
FEATURE_TOKENS: dict[str, tuple[str, ...]] = {
    "regime": ("regime", "tercile", "hmm", "era_"),
    "calendar": ("fomc", "is_fomc", "is_nfp", "is_cpi", "opex", "is_opex", "session"),
    "news": ("news_", "sentiment", "headline", "article"),
    "rates": ("yield", "real_", "breakeven", "_curve", "_2y", "_10y", "_30y"),
    "flow": ("spy_", "qqq_", "iwm_", "gldvslv", "_spread", "ratio"),
    "volatility": ("atr", "rv_", "realized_vol", "garch", "vol_", "stdev", "_vol"),
    "macro": ("dff", "dgs", "vix", "tnx", "fred", "alfred", "cpi_", "ppi_", "nfp"),
    "price": ("close", "open", "high", "low", "log_return", "h5", "ret_", "tr_"),
}

# Exchange closures outside the yearly rules.
SPECIAL_CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02",
    "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)
