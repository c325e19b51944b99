"""Dimension tables. All are fixed values of a bounded size, so they may be broadcast."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFICIAL, MEDIA, REFERENCE = "Official", "Established media", "Reference"
# Domain, name, tier; the order decides.
DOMAINS = [
    ("wbcboxing.com", "WBC", OFFICIAL), ("wbaboxing.com", "WBA", OFFICIAL), ("wboboxing.com", "WBO", OFFICIAL), ("ibf-usba-boxing.com", "IBF", OFFICIAL),
    ("mostvaluablepromotions.com", "Most Valuable Promotions", OFFICIAL), ("matchroomboxing.com", "Matchroom Boxing", OFFICIAL),
    ("premierboxingchampions.com", "Premier Boxing Champions", OFFICIAL), ("toprank.com", "Top Rank", OFFICIAL), ("goldenboy.com", "Golden Boy Promotions", OFFICIAL),
    ("queensberry.co.uk", "Queensberry Promotions", OFFICIAL), ("nj.gov", "New Jersey State Athletic Control Board", OFFICIAL),
    ("tdlr.texas.gov", "Texas Department of Licensing and Regulation", OFFICIAL), ("bbbofc.com", "British Boxing Board of Control", OFFICIAL),
    ("espn.com", "ESPN", MEDIA), ("espn.co.uk", "ESPN", MEDIA), ("bbc.co.uk", "BBC Sport", MEDIA), ("bbc.com", "BBC Sport", MEDIA),
    ("theguardian.com", "The Guardian", MEDIA), ("skysports.com", "Sky Sports", MEDIA), ("badlefthook.com", "Bad Left Hook", MEDIA), ("dazn.com", "DAZN", MEDIA),
    ("ringmagazine.com", "The Ring", MEDIA), ("boxingnewsonline.net", "Boxing News", MEDIA), ("boxingnews24.com", "Boxing News 24", MEDIA),
    ("worldboxingnews.net", "World Boxing News", MEDIA), ("worldboxingnews.com", "World Boxing News", MEDIA), ("fightmag.com", "FightMag", MEDIA),
    ("cbssports.com", "CBS Sports", MEDIA), ("apnews.com", "Associated Press", MEDIA), ("reuters.com", "Reuters", MEDIA),
    ("independent.co.uk", "The Independent", MEDIA), ("telegraph.co.uk", "The Telegraph", MEDIA), ("mb.com.ph", "Manila Bulletin", MEDIA),
    ("en.wikipedia.org", "Wikipedia", REFERENCE),
]
PUBLISHER_ALIASES = {"bbc.com": "bbc.co.uk", "espn.co.uk": "espn.com", "worldboxingnews.com": "worldboxingnews.net"}
RECENT_FEEDS = [
    "https://feeds.bbci.co.uk/sport/boxing/rss.xml", "https://www.espn.com/espn/rss/boxing/news", "https://www.theguardian.com/sport/boxing/rss",
    "https://www.skysports.com/rss/12183", "https://www.badlefthook.com/rss/index.xml", "https://www.boxingnewsonline.net/feed/",
]
SEARCH_FEED_SITES = [
    "https://wbcboxing.com/en", "https://www.wbaboxing.com", "https://wboboxing.com", "https://www.ibf-usba-boxing.com", "https://www.mostvaluablepromotions.com", "https://www.boxingnews24.com",
]
FEED_ONLY_HOSTS = ["feeds.bbci.co.uk"]
STATUSES = ["Conflicting", "Not found", "Single source", "Corroborated", "Confirmed"]
CONFLICTING, NOT_FOUND, SINGLE, CORROBORATED, CONFIRMED = STATUSES
# field, label, several values can hold at once
FIELDS = [
    ("winner", "Result", False), ("method", "Method", False), ("round", "Round", False), ("time", "Time", False), ("scheduled_rounds", "Scheduled rounds", False),
    ("weight_class", "Weight class", False), ("titles", "Titles", True), ("scorecards", "Scorecards", False), ("referee", "Referee", False), ("judges", "Judges", True),
]
DECISIONS = ["UD", "SD", "MD", "TD"]


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DOMAINS)], "pos int, domain string, name string, tier string")


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*f, i) for i, f in enumerate(FIELDS)], "field string, label string, multi boolean, pos int")


def rank_of(status: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1).cast("int")


def status_at(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), rank.cast("int"))


def field_pos(field: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(f[0]) for f in FIELDS]), field) - 1).cast("int")
