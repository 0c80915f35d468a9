"""Series as JSON, CSV, raw text, pickle and protobuf, paths and infos as JSON and protobuf, and the
reduction to a number of points. Whatever is one row for each series is made where the series is."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.plans import frame


def reduced_to(series: DataFrame, most: int) -> DataFrame:
    """Series with at most so many points over the whole range of the list, each by its own
    consolidation function."""
    whole = series.agg(F.min("start").alias("_low"), F.max("stop").alias("_high"))
    rows = series.crossJoin(F.broadcast(whole))
    k = F.greatest(F.ceil(F.floor((F.col("_high") - F.col("_low")) / F.col("step")) / F.lit(most)), F.lit(1))
    values = F.when(k > 1, F.transform(frame.chunked(F.col("values"), k), lambda w: frame.aggregated(w, F.col("agg")))).otherwise(F.col("values"))
    return frame.put(rows, {"values": values, "step": (F.col("step") * k).cast("long")}).drop("_low", "_high")


def _time(i: Column) -> Column:
    return F.col("start") + i * F.col("step")


def plain(v: Column) -> Column:
    """A number in the fewest decimals that tell it apart, without an exponent."""
    text, size = v.cast("string"), F.abs(v)
    large, middle, small = (v.try_cast(f"decimal(38,{places})").cast("string") for places in (0, 18, 30))
    fraction = lambda t: F.regexp_replace(t, r"\.?0*$", "")
    return F.coalesce(F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", "")).when(size >= 1e16, large).when(size >= 1, fraction(middle)).otherwise(fraction(small)), text)


def json_rows(series: DataFrame) -> DataFrame:
    """ord and json: ``{"target": .., "datapoints": [[value, time], ..]}``; NaN and infinities are null."""
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    text = F.transform("values", lambda v, i: F.concat(F.lit("["), F.coalesce(plain(finite(v)), F.lit("null")), F.lit(","), _time(i).cast("long").cast("string"), F.lit("]")))
    target = F.to_json(F.struct(F.col("name").alias("target")))
    return series.select("ord", F.concat(F.regexp_replace(target, r"\}$", ""), F.lit(',"datapoints":['), F.array_join(text, ","), F.lit("]}")).alias("json"))


def csv_rows(series: DataFrame, zone: str = "UTC") -> DataFrame:
    """ord, i and csv: ``"name",YYYY-MM-DD HH:MM:SS,value`` with nothing for an absent point."""
    rows = series.select("ord", "name", "start", "step", F.posexplode_outer("values").alias("i", "v")).filter(F.col("i").isNotNull())
    time = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(_time(F.col("i"))), zone), "yyyy-MM-dd HH:mm:ss")
    return rows.select("ord", "i", F.concat(F.lit('"'), "name", F.lit('",'), time, F.lit(","), F.coalesce(plain(F.col("v")), F.lit(""))).alias("csv"))


def raw_rows(series: DataFrame) -> DataFrame:
    """ord and raw: ``name,start,stop,step|v,v,None``."""
    values = F.array_join(F.transform("values", lambda v: F.coalesce(plain(v), F.lit("None"))), ",")
    return series.select("ord", F.concat(F.concat_ws(",", "name", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("step").cast("string")), F.lit("|"), values).alias("raw"))


def pickled(series: DataFrame) -> bytes:
    """A list of dicts, as pickle. Rows are streamed to the driver, which writes the one file."""

    def rows() -> Iterator[dict]:
        for r in series.orderBy("ord").toLocalIterator():
            yield {"name": r["name"], "start": r["start"], "end": r["stop"], "step": r["step"], "values": list(r["values"])}

    return pickle.dumps(list(rows()), protocol=2)


def find_json(found: DataFrame, query: str) -> DataFrame:
    """id and json of what a find gave (path, is_leaf), one object for each, by text. The id is the
    query's own beginning with the last node of the path."""
    base = query[: query.rfind(".") + 1]
    text = F.substring_index("path", ".", -1)
    rows = found.groupBy(F.concat(F.lit(base), text).alias("id"), text.alias("text")).agg(F.max("is_leaf").alias("is_leaf"))
    inner = F.when(F.col("is_leaf"), 0).otherwise(1)
    made = F.struct(inner.alias("allowChildren"), F.create_map().cast("map<string,int>").alias("context"), inner.alias("expandable"), "id", (1 - inner).alias("leaf"), "text")
    return rows.select("id", F.to_json(made).alias("json"))


def completer_json(found: DataFrame) -> DataFrame:
    """path and json of what ``complete`` gave: paths of inner nodes end with a point, and have no name."""
    path = F.when(F.col("is_leaf"), F.col("path")).otherwise(F.concat("path", F.lit(".")))
    made = F.struct(path.alias("path"), F.when(F.col("is_leaf"), F.substring_index("path", ".", -1)).otherwise("").alias("name"), F.when(F.col("is_leaf"), "1").otherwise("0").alias("is_leaf"))
    return found.select(path.alias("path"), F.to_json(made).alias("json"))


def info_json(infos: DataFrame, aggregation: str = "", factor: float = 0.0) -> DataFrame:
    """name and json of infos (name, step, points, first_ts, last_ts): one retention for each step."""
    kept = F.sort_array(F.collect_list(F.struct(F.col("step").cast("int").alias("secondsPerPoint"), F.col("points").cast("int").alias("numberOfPoints"))))
    rows = infos.groupBy("name").agg(kept.alias("retentions"), F.max(F.col("last_ts") - F.col("first_ts") + F.col("step")).cast("int").alias("maxRetention"))
    made = F.struct("name", F.lit(aggregation).alias("aggregationMethod"), "maxRetention", F.lit(factor).alias("xFilesFactor"), "retentions")
    return rows.select("name", F.to_json(made).alias("json"))
