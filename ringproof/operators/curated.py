"""The curated table: looked up by names or aliases in either order, and what it can tell."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name


def lookup_curated(requests: DataFrame, curated: DataFrame) -> DataFrame:
    """request_id, pos: the first curated fight of each request. requests: request_id, boxer_a, boxer_b, on (date or null); curated: pos, fighter_a, fighter_b, event_date, offered_date, aliases.

    Aliases count for either side. Both orders of the names are one equi-join, on a key of the two names."""
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalise_name)
    names = curated.select("pos", "event_date", "offered_date", F.explode(F.array_distinct(F.concat(F.array(normalise_name(F.col("fighter_a"))), aliases))).alias("x"), F.concat(F.array(normalise_name(F.col("fighter_b"))), aliases).alias("ys"))
    pairs = names.select("pos", "event_date", "offered_date", "x", F.explode(F.array_distinct("ys")).alias("y"))
    keys = pairs.union(pairs.select("pos", "event_date", "offered_date", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    asked = requests.select("request_id", "on", normalise_name(F.col("boxer_a")).alias("x"), normalise_name(F.col("boxer_b")).alias("y"))
    met = asked.join(keys, ["x", "y"]).where(F.col("on").isNull() | (F.col("on") == F.col("event_date")) | (F.col("on") == F.col("offered_date")))
    return met.groupBy("request_id").agg(F.min("pos").alias("pos"))


def data_availability(curated: DataFrame) -> DataFrame:
    """pos, field, status: seven rows a fight."""
    downs = F.lower(F.array_join("knockdowns", " "))
    rows = {
        "Outcome": F.col("confidence"), "Method": F.col("confidence"), "Round / time": F.col("confidence"),
        "Scorecards": F.when(F.col("scorecards").isin("Not applicable", "Partial / source review required"), "Review").otherwise("Available"),
        "Knockdowns": F.when(downs.rlike("requires|reported"), "Review").otherwise("Unavailable"), "Round statistics": F.lit("Unavailable"),
        "Officials": F.when(F.contains("officials", F.lit("To be collected")), "Review").otherwise("Available"),
    }
    return curated.select("pos", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("status")) for k, v in rows.items()])).alias("x")).select("pos", "x.*")
