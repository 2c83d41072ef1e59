"""JSON payloads: unpivoting features from raw snapshots, and checking model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import to_number


# Fixed fields of each endpoint that are kept as features.
KEPT_FIELDS = {
    "profile": [
        "price", "beta", "volAvg", "mktCap", "lastDiv", "isEtf", "isFund", "isActivelyTrading",
    ],
    "ratios": [
        "currentRatio", "quickRatio", "cashRatio", "debtRatio", "debtEquityRatio", "interestCoverage", "grossProfitMargin",
        "operatingProfitMargin", "netProfitMargin", "returnOnAssets", "returnOnEquity", "priceEarningsRatio", "priceToBookRatio",
        "priceToSalesRatio", "priceToFreeCashFlowsRatio", "dividendYield", "enterpriseValueMultiple", "priceFairValue",
    ],
    "key_metrics": [
        "marketCap", "enterpriseValue", "peRatio", "pbRatio", "pfcfRatio", "pocfratio", "evToSales", "enterpriseValueOverEBITDA",
        "evToOperatingCashFlow", "evToFreeCashFlow", "earningsYield", "freeCashFlowYield", "netDebtToEBITDA", "debtToEquity",
        "currentRatio", "interestCoverage", "revenuePerShare", "netIncomePerShare", "operatingCashFlowPerShare", "freeCashFlowPerShare",
        "bookValuePerShare", "tangibleBookValuePerShare", "capexPerShare", "dividendYield", "payoutRatio",
    ],
    "key_metrics_ttm": [
        "peRatioTTM", "pbRatioTTM", "pfcfRatioTTM", "pocfratioTTM", "enterpriseValueOverEBITDATTM", "freeCashFlowYieldTTM",
        "earningsYieldTTM", "revenuePerShareTTM", "netIncomePerShareTTM", "operatingCashFlowPerShareTTM", "freeCashFlowPerShareTTM",
        "dividendYieldTTM", "payoutRatioTTM", "peRatio", "pbRatio", "pfcfRatio", "pocfratio", "enterpriseValueOverEBITDA",
        "freeCashFlowYield", "earningsYield", "revenuePerShare", "netIncomePerShare", "operatingCashFlowPerShare", "freeCashFlowPerShare",
        "dividendYield", "payoutRatio",
    ],
}


def objects(payload: Column) -> Column:
    """An object as an array of one map, an array as its objects, anything else as an empty array; values as text."""
    t = F.trim(payload)
    many = F.from_json(t, "array<map<string,string>>")
    one = F.from_json(t, "map<string,string>")
    none = F.array().cast("array<map<string,string>>")
    return F.coalesce(F.when(t.startswith("["), F.filter(many, lambda m: m.isNotNull())).when(t.startswith("{"), F.array(one)), none)


def endpoint_prefix(path: Column) -> Column:
    """`/stable/ratios-ttm?x=1` becomes `ratios_ttm`."""
    return F.translate(F.regexp_extract(path, r"([^/?]+)/*(?:\?.*)?$", 1), "-", "_")


def unpivot(snapshots: DataFrame, keys: list[str], payload: str, prefix: Column, wanted: list[str], fetched: str) -> DataFrame:
    """keys, asof_date, feature (`prefix.key`), value of the wanted keys of each object. The date is the object's date, report date, calendar year (its first day), or the fetch date. Values that are no number are left out."""
    rows = snapshots.select(*keys, F.col(fetched).alias("__f"), prefix.alias("__p"), F.explode(objects(F.col(payload))).alias("m"))
    m = lambda k: F.nullif(F.trim(F.try_element_at("m", F.lit(k))), F.lit(""))
    asof = F.coalesce(F.substring(m("date"), 1, 10).try_cast("date"), F.substring(m("reportedDate"), 1, 10).try_cast("date"), F.concat(m("calendarYear"), F.lit("-01-01")).try_cast("date"), F.col("__f").cast("date"))
    long = rows.select(*keys, asof.alias("asof_date"), "__p", F.explode("m").alias("k", "v")).filter(F.col("k").isin(wanted))
    return long.select(*keys, "asof_date", F.concat_ws(".", "__p", "k").alias("feature"), to_number(F.col("v")).alias("value")).filter("value IS NOT NULL")


OUTPUT = "sentiment string, confidence int, relevance int, explanation string, tickers array<string>, scope string, evidence array<string>"


def checked_output(raw: Column, text: Column | None = None) -> Column:
    """Whether a model's JSON has the agreed fields, values in range and nothing else (and evidence that the text holds)."""
    p = F.from_json(raw, OUTPUT)
    keys = F.json_object_keys(raw)
    allowed = F.array(*[F.lit(x.split(" ")[0]) for x in OUTPUT.split(", ")])
    good = p.isNotNull() & p["sentiment"].isin("positive", "neutral", "negative") & p["confidence"].between(1, 10) & p["relevance"].between(1, 10) & (F.length(p["explanation"]) <= 400) & (F.size(F.array_except(keys, allowed)) == 0)
    if text is not None:
        good = good & F.forall(F.coalesce(p["evidence"], F.array().cast("array<string>")), lambda e: F.contains(text, e))
    return F.coalesce(good, F.lit(False))
