"""Raw API payload columns to readings and ingestion outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.functions.numbers import traffic_level
from cityflux.schemas import NO_AQI_ERROR


# Only the parts read.
_FLOW = "flowSegmentData struct<freeFlowSpeed: double, currentSpeed: double>"
_AIR = "status string, data struct<aqi: string>"


def parse_payloads(df: DataFrame, traffic: str = "traffic_json", aqi: str = "aqi_json") -> DataFrame:
    """Both payload columns replaced by index and level.

    Level from the flow object: object missing gives 1, a missing speed counts as 0. Index when the
    status is ok and the text is a whole number. The texts are parsed in a step of their own, so
    that each is parsed once however often its parts are used.
    """
    parsed = df.withColumns({"_flow": F.from_json(traffic, _FLOW)["flowSegmentData"], "_air": F.from_json(aqi, _AIR)})
    speeds = [F.coalesce(F.col(f"_flow.{c}"), F.lit(0.0)) for c in ("freeFlowSpeed", "currentSpeed")]
    level = F.when(F.col("_flow").isNull(), 1).otherwise(traffic_level(*speeds))
    index = F.when(F.col("_air.status") == "ok", F.col("_air.data.aqi").try_cast("int"))
    return parsed.withColumns({"aqi_value": index, "traffic_level": level}).drop("_flow", "_air", traffic, aqi)


def ingest_results(df: DataFrame) -> DataFrame:
    """One outcome per payload pair; a reading without an index is a kept failure."""
    parsed = parse_payloads(df)
    ok = F.col("aqi_value").isNotNull()
    return parsed.select(
        "id", "location", "aqi_value", "traffic_level",
        ok.alias("success"),
        F.when(~ok, NO_AQI_ERROR).alias("error_message"),
    )
