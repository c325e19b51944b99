"""Quality rules with adaptive thresholds.

Each document gives five whole-number features. A sketch is a table of bucket counts on a log-linear scale (a bucket
keeps the BITS leading bits of a value, so it is off by at most 1 in 2**(BITS - 1)); sketches merge by adding counts,
exactly and in any order. Sketches of the documents that pass the base rules are built per language and source and merged
into one per language and one of all.

All fences are quantiles of the sketches. A dense feature may lie REACH times as far from its median as its 90th (or 10th)
percentile does. A sparse one, which is zero for most documents, may reach its TOP percentile, or the median of its values
above zero if that is greater. A language's fences are mixed with those of all as if PRIOR documents had the latter, and a
group's with its language's likewise, so that small groups lean on more documents and none is left out. The fences are
joined to the documents, and those outside a fence go.

Defined results: a null text has no words (and fails the base rules); null languages or sources form a group of their
own; rows that repeat a doc_id keep a row each; a group without a document that passes the base rules keeps none.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_sized, map_arrow, table

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
BITS = 5
REACH = 3
TOP = 98  # per cent
PRIOR = 200  # documents
#: feature: (dense, with a lower fence); in millionths, word length in thousandths.
FEATURES = {"symbols_ppm": (False, False), "repeats_ppm": (False, False), "dup_lines_ppm": (False, False), "capitals_ppm": (True, False), "word_milli": (True, True)}
SIDES = [f"{f}_{side}" for f, (_, low) in FEATURES.items() for side in (("low", "high") if low else ("high",))]
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\t\n\x0b\x0c\r "
_NO_CAPITALS = bytes(range(65, 91))


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_capitals (A-Z)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(seen := set(grams)) < len(grams):
            count: dict = dict.fromkeys(seen, 0)
            for g in grams:
                count[g] += 1
            upto = 0
            for i, g in enumerate(grams):
                if count[g] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(text) - (len(data) - len(data.translate(None, _BLANKS))), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(data) - len(data.translate(None, _NO_CAPITALS))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

    def make():
        def run(rows):
            found = [measure(t) for t in rows["text"]]
            return {n: rows[n] for n in ("id", "lang", "source")} | {n: [f[i] for f in found] for i, n in enumerate(names)}

        return run

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return map_arrow(picked, make, "id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def features(measured: DataFrame) -> DataFrame:
    share = lambda part, whole, scale: F.expr(f"{part} * {scale} div greatest({whole}, 1)")
    return measured.withColumns({
        "symbols_ppm": share("n_symbols", "word_chars", 1_000_000),
        "repeats_ppm": share("n_repeat_words", "n_words", 1_000_000),
        "dup_lines_ppm": share("n_dup_lines", "n_lines", 1_000_000),
        "capitals_ppm": share("n_capitals", "word_chars", 1_000_000),
        "word_milli": share("word_chars", "n_words", 1_000),
    })


def _bucket(v: str) -> str:
    """SQL, for either engine: the value with all but its leading bits cleared."""
    shift = f"greatest(length(bin({v})) - {BITS}, 0)"
    return f"(({v} >> {shift}) << {shift})"


def sketch(featured: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: sketches per group. Counts are combined before the shuffle."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES]))
    long = featured.select("lang", "source", rows.alias("x")).select("lang", "source", "x.feature", "x.v")
    return long.groupBy("lang", "source", "feature", F.expr(_bucket("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(upto: str, total: str, zeros: str) -> dict[str, str]:
    """SQL aggregates, for either engine, over the buckets of a sketch."""
    at = lambda per_cent: f"min(case when {upto} * 100 >= {total} * {per_cent} then bucket end)"
    middle = f"coalesce(min(case when bucket > 0 and ({upto} - {zeros}) * 2 >= {total} - {zeros} then bucket end), 0)"
    return {"q10": at(10), "q50": at(50), "q90": at(90), "top_q": at(TOP), "middle": middle}


def _fence(feature: str, side: str) -> str:
    """SQL, for either engine, of the columns that _quantiles names."""
    dense, _ = FEATURES[feature]
    if side == "low":
        return f"q50 - {REACH} * (q50 - q10)"
    return f"q50 + {REACH} * (q90 - q50)" if dense else "greatest(top_q, middle)"


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, n, and for each feature its low and high fence."""
    group = Window.partitionBy(*keys, "feature")
    ranked = sketches.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group), "zeros": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(group)})
    found = ranked.groupBy(*keys, "feature").agg(F.max("total").alias("n"), *[F.expr(q).alias(name) for name, q in _quantiles("upto", "total", "zeros").items()])
    columns = [F.max(F.when(F.col("feature") == s.rpartition("_")[0], F.expr(_fence(*s.rpartition("_")[::2])))).alias(s) for s in SIDES]
    return (found.groupBy(*keys) if keys else found.groupBy()).agg(F.max("n").alias("n"), *columns)


def _mixed(n: str, own: str, wider: str) -> str:
    """SQL, for Spark: a fence and one of more documents, weighed."""
    return f"({n} * {own} + {PRIOR} * {wider}) div ({n} + {PRIOR})"


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and the fences that hold there."""
    named = lambda df, tag, *keys: df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in ("n", *SIDES)])
    overall = named(fences(merge(sketches)), "all")
    by_lang = named(fences(merge(sketches, "lang"), "lang"), "lang", "lang").join(F.broadcast(overall))  # one row
    by_lang = by_lang.select("lang", *[F.expr(_mixed("lang_n", f"lang_{s}", f"all_{s}")).alias(f"lang_{s}") for s in SIDES])
    own = named(fences(sketches, "lang", "source"), "own", "lang", "source").join(by_lang, "lang")
    return own.select("lang", "source", *[F.expr(_mixed("own_n", f"own_{s}", f"lang_{s}")).alias(s) for s in SIDES])


def judged(docs: DataFrame, **columns: str) -> DataFrame:
    """A row for each row of docs: id, measures, features, base_failed, kept."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = scratch.save(features(measures(docs, **columns)).withColumn("base_failed", failed), "measures")
    limits = scratch.save(thresholds(scratch.save(sketch(rows.where("not base_failed")), "sketches")), "thresholds")
    inside = F.lit(True)
    for s in SIDES:
        f, _, side = s.rpartition("_")
        value = F.expr(_bucket(f))
        inside &= value <= F.col(s) if side == "high" else value >= F.col(s)
    return join_sized(rows, limits, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _fence_sql(sketches: str, keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    sides = ", ".join(f"max(case when feature = '{f}' then {_fence(f, side)} end) as {f}_{side}" for f, _, side in (s.rpartition("_") for s in SIDES))
    quantiles = ", ".join(f"{q} as {name}" for name, q in _quantiles("upto", "total", "zeros").items())
    return f"""
  select {by}max(n) as n, {sides} from (
    select {by}feature, max(total) as n, {quantiles} from (
      select *, sum(n) over (partition by {by}feature order by bucket) as upto, sum(n) over (partition by {by}feature) as total,
             sum(case when bucket = 0 then n else 0 end) over (partition by {by}feature) as zeros from ({sketches}))
    group by {by}feature) {'group by ' + ', '.join(keys) if keys else ''}"""


_WIDER_SQL = ", ".join(f"cast((l.n * l.{s} + {PRIOR} * o.{s}) // (l.n + {PRIOR}) as hugeint) as {s}" for s in SIDES)
_OWN_SQL = ", ".join(f"cast((g.n * g.{s} + {PRIOR} * l.{s}) // (g.n + {PRIOR}) as hugeint) as {s}" for s in SIDES)
OP1_SQL = rf"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), w as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)
), g as (
  select doc_id, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as gram from w window o as (partition by doc_id order by pos)
), r as (
  select doc_id, pos, gram is not null and count(*) over (partition by doc_id, gram) > 1 as again from g
), c as (
  select doc_id, again or coalesce(lag(again) over o, false) or coalesce(lag(again, 2) over o, false) as hit from r window o as (partition by doc_id order by pos)
), rep as (select doc_id, count(*) filter (where hit) as n from c group by doc_id),
l as (
  select doc_id, unnest(string_split(text, chr(10))) as line from d
), dup as (
  select doc_id, count(*) as n, count(*) - count(distinct line) as again from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), m as (
  select d.doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals,
         coalesce(dup.again, 0)::bigint as n_dup_lines, coalesce(dup.n, 0)::bigint as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join dup on d.doc_id = dup.doc_id left join rep on d.doc_id = rep.doc_id
), f as (
  select *, n_symbols * 1000000 // greatest(word_chars, 1) as symbols_ppm, n_repeat_words * 1000000 // greatest(n_words, 1) as repeats_ppm,
         n_dup_lines * 1000000 // greatest(n_lines, 1) as dup_lines_ppm, n_capitals * 1000000 // greatest(word_chars, 1) as capitals_ppm,
         word_chars * 1000 // greatest(n_words, 1) as word_milli
  from m
), b as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from f
), long as (
  {' union all '.join(f"select lang, source, '{x}' as feature, {x} as v from b where not base_failed" for x in FEATURES)}
), sk as (
  select lang, source, feature, {_bucket('v')} as bucket, count(*) as n from long group by all
), own as ({_fence_sql('select * from sk', ['lang', 'source'])}),
by_lang as ({_fence_sql('select lang, feature, bucket, sum(n) as n from sk group by all', ['lang'])}),
overall as ({_fence_sql('select feature, bucket, sum(n) as n from sk group by all', [])}),
wider as (select l.lang, {_WIDER_SQL} from by_lang l cross join overall o),
t as (select g.lang, g.source, {_OWN_SQL} from own g join wider l on g.lang = l.lang),
j as (
  select b.*, {' and '.join(f"{_bucket('b.' + s.rpartition('_')[0])} {'<=' if s.endswith('high') else '>='} t.{s}" for s in SIDES)} as inside
  from b left join t on b.lang = t.lang and b.source = t.source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(inside, false) as kept from j
"""
