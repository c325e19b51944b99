"""Mixing sources to target weights, native: weighted fair queueing.

Every document has a place in the shuffled queue of its source, and its virtual finish time is the words of the source up
to and with it, divided by the source's target. A source that must give more words than it has is queued up to `repeats`
times, one round after the other. All copies are sorted by finish time, over all sources, and cut where the total budget is
used up; so every source comes within about a document of its target.

How it holds at scale. Queues and the global order are sums over ranges: the hashes that shuffle a source are dealt into
about sqrt(n) ranges, whose sums give each range its start, and only within a range are rows sorted. Finish times are dealt
into ranges likewise: the sums of the ranges tell the one that holds the cut, and only its rows are put in order. A source
with any share of the rows is spread over all ranges. Rows that agree in all that is read here are one row with a count
until they have their starts. Texts are read once and never move. Only DataFrame functions are used.

Defined results: a null text has no words; a null source is a source, the last one; rows that repeat a doc_id are
documents of their own; a null doc_id is shuffled as the empty text. Documents without words take none. Without any word
all targets are 0. One row for each source is sorted in one task: a source here is an entry of a mixture, not a document.
Targets are exact quotients of whole numbers, rounded once.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, join_bounded, table

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 7
#: Equal rows that one task writes out; more are dealt anew first.
CHUNK = 10_000
#: Finish times up to this have ranges of equal width, later ones of equal ratio.
EVEN_UPTO = 4
_HASH_BITS = 60


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, n (how many rows are equal) and h, 60 bits that shuffle."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.conv(F.substring(key, 1, _HASH_BITS // 4), 16, 10).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, rank (from 0) and target, from a row for each source: source, source_size.

    The budget is the sum of all sizes. Sources in order of their limit for a unit of weight: the first that its share, what
    those before it leave, does not exceed is free, and so are all after it; those before it are at their limits."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    unit = math.lcm(*weights)  # limit * unit / weight is a whole number
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", F.col("source_size") * repeats)
    every = Window.partitionBy()
    before = Window.orderBy(F.expr(f"limit * ({unit} div weight)"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    nought = lambda c: F.coalesce(c, F.lit(0))
    shared = ranked.withColumns({"budget": F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "used": nought(F.sum("limit").over(before)), "gone": nought(F.sum("weight").over(before))})
    free = big("limit") * (F.col("weights") - F.col("gone")).cast("decimal(18,0)") >= (F.col("budget") - F.col("used")).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    shared = shared.withColumn("free", free)
    at_limit = lambda c: nought(F.sum(F.when(~F.col("free"), F.col(c))).over(every))
    share = ((F.col("budget") - at_limit("limit")) * F.col("weight")).cast("double") / (F.col("weights") - at_limit("weight")).cast("double")
    return shared.select("source", "source_size", "rank", F.when(F.col("free"), share).otherwise(F.col("limit").cast("double")).alias("target"))


def queued(rows: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """A written row for each document: doc_id, size, source_size, target, rank, upto (the source's words up to and with it)."""
    rows = scratch.save(rows, "sizes")
    bits = _ranges(rows.count())
    rows = rows.withColumn("range", F.shiftright("h", _HASH_BITS - bits))
    sums = scratch.save(rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count(F.lit(1)).alias("rows")), "ranges")
    plan = scratch.save(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats), "targets")
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    starts = join_bounded(starts, plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    starts = scratch.save(starts.withColumnsRenamed({"source": "_source", "range": "_range"}), "starts")
    # Rows and starts meet by (source, range), and the window needs just that: one shuffle of narrow rows.
    met = rows.join(starts.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    within = Window.partitionBy("source", "range").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))
    placed = scratch.save(met.withColumn("first", upto).select("doc_id", "size", "n", "source_size", "target", "rank", "first"), "placed")
    # Equal rows part again.
    whole = lambda df: df.select("doc_id", "size", "source_size", "target", "rank", (F.col("first") + F.col("size") * F.col("i")).alias("upto"))
    few = placed.where(F.col("n") <= CHUNK).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    many = placed.where(F.col("n") > CHUNK).withColumn("c", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}")))).repartition("c")
    many = many.withColumn("i", F.explode(F.sequence(F.col("c") * CHUNK + 1, F.least((F.col("c") + 1) * CHUNK, F.col("n")))))
    return scratch.save(whole(few).unionByName(whole(many)), "queue")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, finish (of the first copy; null for a target of 0): a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "mixing")
    queue = queued(sized(docs, id_col, text_col, source_col, seed), scratch, weights, repeats)
    finish = lambda i: F.when(F.col("target") > 0, (F.lit(i) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    key = lambda i: F.struct(finish(i).alias("finish"), F.col("rank"), F.lit(i).alias("i"), F.col("upto"))
    taken = F.lit(0).cast("long")
    if stop := _first_left(queue.where("size > 0"), key, repeats, scratch):
        limit = F.struct(F.lit(stop.finish).alias("finish"), F.lit(stop["rank"]).alias("rank"), F.lit(stop.i).alias("i"), F.lit(stop.upto).cast("long").alias("upto"))
        for i in range(repeats):
            taken = taken + F.when(key(i) < limit, F.col("size")).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"), finish(0).alias("finish"))


def _ranges(rows: int) -> int:
    """Bits of about sqrt(rows) ranges."""
    return max(1, math.ceil(math.log2(max(rows, 2)) / 2))


def _first_left(queue: DataFrame, key, repeats: int, scratch: Scratch):
    """The first copy, in order of finish, that the budget has no room for; None if there are no words.

    Sums of ranges of finish times, a row a range, tell the range in which the budget ends; only its rows are put in order."""
    copies = queue.select("size", F.explode(F.array(*[key(i) for i in range(repeats)])).alias("key"))
    width = float(1 << _ranges(queue.count()))
    late = F.floor(F.log2(F.col("key.finish") / EVEN_UPTO) * width) + int(EVEN_UPTO * width)
    copies = copies.withColumn("range", F.when(F.col("key.finish") < EVEN_UPTO, F.floor(F.col("key.finish") * width)).otherwise(late))
    sums = scratch.save(copies.groupBy("range").agg(F.sum("size").alias("words")), "finish")
    budget = queue.agg(F.sum("size")).first()[0]
    if not budget:
        return None
    before = F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("before", before).where((F.col("before") <= budget) & (F.col("before") + F.col("words") > budget)).first()
    upto = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + at.before
    return copies.where(F.col("range") == at["range"]).withColumn("upto", upto).where(F.col("upto") > budget).agg(F.min("key").alias("key")).first().key


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("finish")


_WEIGHT_SQL = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
_UNIT = math.lcm(*WEIGHTS)
OP13_SQL = rf"""
with d as materialized (
  select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source
), w as (
  select *, case rank % {len(WEIGHTS)} {_WEIGHT_SQL} end as weight, source_size * {REPEATS} as most, sum(source_size) over () as budget from s
), b as (
  select *, sum(weight) over () as weights, coalesce(sum(most) over o, 0) as used, coalesce(sum(weight) over o, 0) as gone
  from w window o as (order by most * ({_UNIT} // weight), rank rows between unbounded preceding and 1 preceding)
), f as (
  select *, most::hugeint * (weights - gone) >= (budget - used)::hugeint * weight as free from b
), t as materialized (
  select source, source_size, rank, case when free then ((budget - coalesce(sum(most) filter (where not free) over (), 0)) * weight)::double
         / (weights - coalesce(sum(weight) filter (where not free) over (), 0))::double else most::double end as target
  from f
), q as (
  select d.*, t.source_size, t.target, t.rank,
         (sum(size) over (partition by d.source order by md5('{SEED}:' || coalesce(doc_id::varchar, ''))[1:15], doc_id nulls first, size, r rows unbounded preceding))::bigint as upto
  from d join t on d.source is not distinct from t.source
), c as (
  select r, size, rank, i, upto, (i * source_size + upto)::double / target as finish from q cross join range({REPEATS}) e(i) where size > 0 and target > 0
), k as (
  select r, sum(case when total <= (select sum(size) from d) then size else 0 end)::bigint as taken
  from (select *, sum(size) over (order by finish, rank, i, upto rows unbounded preceding) as total from c) group by r
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::bigint as taken from q left join k on q.r = k.r
"""
