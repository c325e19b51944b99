"""Bouts and reports that Spark derives from the order tables: an order is a bout, each of its lines a report about it.

The wording of a report follows from the line's quantity and flags; PARAMS is the SQL that gives the same choices to
another engine, so what the rules find can be compared with what was written, without reading the text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import boxer_of
from ..sources import dims

FIRST = "Isaac Nestor Omar Leo Marco Pavel Hugo Diego Kenji Luca Andre".split()
LAST = "Cruz Bravo Hart Lopez Novak Okafor Silva Tanaka Moreau Keller Santos Ivanov Castillo".split()
METHOD_KEYS = ["KO", "TKO", "UD", "SD", "PTS"]
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
CARDS = "117-111,116-112,115-113"
FILLER = "The crowd at the arena saw a good night of sport and many of the fans stayed late to talk about what they had seen there."
TODAY = "1998-08-15"


def case(index: str, values: list) -> str:
    """SQL of either engine: the value at an index."""
    quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "(case " + index + " " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end)"


_FA, _FB = "((o_custkey + o_orderkey) % 11)", "(((o_custkey + o_orderkey) % 11 + 1 + o_orderkey % 10) % 11)"
_IA, _IB = "(o_custkey % 13)", "((o_custkey * 7 + o_orderkey) % 13)"
FIGHTS_SQL = f"""select o_orderkey as fight_id, cast(o_orderdate as date) as event_date,
  {case(_FA, FIRST)} || ' ' || {case(_IA, LAST)} as name_a, {case(_FB, FIRST)} || ' ' || {case(_IB, LAST)} as name_b, {case(_IA, LAST)} as sur_a, {case(_IB, LAST)} as sur_b from orders"""
REPORTS_SQL = "select l_orderkey as fight_id, l_linenumber as source_id, min(l_suppkey) as sup, min(cast(l_quantity as int)) as q, min(l_returnflag) as rf from lineitem group by l_orderkey, l_linenumber"
_W = "(case when q % 2 = 0 then name_a else name_b end)"
PARAMS = f"""
  select r.*, f.event_date, f.name_a, f.name_b, f.sur_a, f.sur_b, case when q % 2 = 0 then 'A' else 'B' end as winner, case when q % 2 = 0 then 'B' else 'A' end as loser,
    {_W} as w, (case when q % 2 = 0 then name_b else name_a end) as l, q % 5 as kind, 1 + q % 12 as rnd, cast(q % 3 as varchar(9)) || ':' || cast(10 + q % 50 as varchar(9)) as clock, sup % {len(dims.DOMAINS)} as dom
  from ({REPORTS_SQL}) r join ({FIGHTS_SQL}) f on r.fight_id = f.fight_id"""


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a statement over the order tables; no view of the session is touched."""
    for n in ("orders", "lineitem"):
        sql = sql.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem")})


def fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fight_id, event_date, boxer_a, boxer_b, event_name, a, b."""
    out = read(spark, sf_dir, FIGHTS_SQL)
    return out.select("fight_id", "event_date", F.col("name_a").alias("boxer_a"), F.col("name_b").alias("boxer_b"), F.concat("sur_a", F.lit(" vs "), "sur_b").alias("event_name"), boxer_of(F.col("name_a"), F.col("name_a")).alias("a"), boxer_of(F.col("name_b"), F.col("name_b")).alias("b"))


def body(w: str = "w", loser: str = "l") -> Column:
    """The text of a report."""
    c, q = F.col, F.col("q")
    at = F.concat(F.lit(" at "), c("clock"), F.lit(" of the "), F.expr(case("rnd - 1", ORDINALS)), F.lit(" round."))
    led = {0: [c(w), F.lit(" knocked out "), c(loser), at], 1: [c(w), F.lit(" defeated "), c(loser), F.lit(" by TKO"), at], 2: [c(w), F.lit(" defeated "), c(loser), F.lit(" by unanimous decision.")], 3: [c(w), F.lit(" beat "), c(loser), F.lit(" by split decision.")], 4: [c(w), F.lit(" beat "), c(loser), F.lit(" on points.")]}
    result = F.concat(*led[4])
    for k in (3, 2, 1, 0):
        result = F.when(c("kind") == k, F.concat(*led[k])).otherwise(result)
    return F.concat_ws(
        " ", result,
        F.when(c("kind").isin(2, 3), F.concat(F.lit("Judges scored it 116-112, 115-113 and 117-111 for "), c(w), F.lit("."))),
        F.when(c("rf") == "A", F.concat(c(w), F.lit(" retained the WBC interim super lightweight title."))).when(c("rf") == "N", F.concat(c(w), F.lit(" captured the WBO welterweight title."))),
        F.when(q % 4 == 0, F.concat(F.lit("Referee Tom Reed watched "), c(loser), F.lit("."))).when(q % 4 == 1, F.concat(F.lit("Referee Ana Poe watched "), c(loser), F.lit("."))),
        F.lit(FILLER),
        F.when(q % 7 == 0, F.concat(c(w), F.lit(" won the 12-round bout."))),
        F.when(q % 3 == 0, F.concat(c(loser), F.lit(" was knocked down "), F.when(q % 6 == 0, F.lit("twice ")).otherwise(F.lit("")), F.lit("in round "), (1 + q % 4).cast("string"), F.lit("."))),
        F.lit(FILLER),
        F.concat(c(loser), F.lit(" will seek a rematch and could beat "), c(w), F.lit(".")),
        F.concat(F.lit("On the undercard "), c(w), F.lit(" saw a heavyweight bout.")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fight_id, source_id, url, title, published, event_date, event_name, a, b, body."""
    p = read(spark, sf_dir, PARAMS)
    url = F.concat(F.lit("https://www."), F.expr(case("dom", [d for d, _, _ in dims.DOMAINS])), F.lit("/report/"), F.col("fight_id").cast("string"), F.lit("/"), F.col("source_id").cast("string"))
    title = F.when(F.col("q") % 2 == 0, F.concat("w", F.lit(" beats "), "l")).otherwise(F.concat("sur_a", F.lit(" meets "), "sur_b"))
    return p.select("fight_id", F.col("source_id").cast("int").alias("source_id"), url.alias("url"), title.alias("title"), F.expr("date_add(event_date, source_id - 3)").alias("published"), "event_date", F.concat("sur_a", F.lit(" vs "), "sur_b").alias("event_name"), boxer_of(F.col("name_a"), F.col("name_a")).alias("a"), boxer_of(F.col("name_b"), F.col("name_b")).alias("b"), body().alias("body"))
