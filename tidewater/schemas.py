"""Fixed schemas of the data model; timestamps are long nanoseconds since the epoch, UTC."""

from __future__ import annotations

BAR = "ts_nanos LONG, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, span_secs INT"
SERIES = "ts_nanos LONG, series STRING, value DOUBLE"
FACTOR = "ts_nanos LONG, factor STRING, value DOUBLE"
YIELD = "ts_nanos LONG, tenor STRING, yield_pct DOUBLE"
PAGEVIEWS = "ts_nanos LONG, article STRING, views LONG"
UNIVERSE = "symbol STRING, name STRING, sector STRING, weight DOUBLE"
POSITIONING = "ts_nanos LONG, contract STRING, mm_long LONG, mm_short LONG, prod_long LONG, prod_short LONG, mm_net LONG, prod_net LONG"
WEATHER = "ts_nanos LONG, station STRING, temp_f DOUBLE, dewp_f DOUBLE, slp DOUBLE, wdsp_mph DOUBLE, prcp_in DOUBLE"
WORLD = "ts_nanos LONG, country STRING, indicator STRING, value DOUBLE"
FILINGS = "ts_nanos LONG, accession STRING, form STRING, primary_doc_url STRING, report_date STRING"
SURVEY = "ts_nanos LONG, bull_pct DOUBLE, neutral_pct DOUBLE, bear_pct DOUBLE, bull_bear_spread DOUBLE"
FEATURES = "ts_nanos LONG, series STRING, feature STRING, value DOUBLE"
EQUITY = "ts_nanos LONG, nav DOUBLE"
CATALOG = "dataset_id STRING, source STRING, asset_class STRING, symbol STRING, path STRING, n_rows LONG, first_ts_nanos LONG, last_ts_nanos LONG, frequency STRING, license_url STRING, fetched_at STRING, notes STRING"
JOURNAL = "kind STRING, ts LONG, symbol STRING, payload STRING"
AUDIT = "ts LONG, strategy STRING, symbol STRING, action STRUCT<type: STRING, side: STRING, qty: DOUBLE>, regime STRING, features MAP<STRING, DOUBLE>, notes STRING"

# header line of a file -> kind of series it holds (exact comparison)
HEADERS = {
    "ts_nanos,symbol,open,high,low,close,volume,span_secs": "bar",
    "ts_nanos,series,value": "series",
    "ts_nanos,factor,value": "factor",
    "ts_nanos,tenor,yield_pct": "yield",
    "ts_nanos,article,views": "pageviews",
}
