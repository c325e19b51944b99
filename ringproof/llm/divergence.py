"""Source divergence audit by iceberg prefix refinement.

Terms are runs of letters. The terms that a language keeps, those in enough of its documents, are found level by level: the
distinct documents of every prefix of `LEVELS[k]` bytes are counted, prefixes in too few documents are discarded, and only
terms whose prefix survived are looked at on the next level, with longer prefixes. A term carries an end mark, so a prefix
that holds the mark is a complete term, which is kept or discarded for good. Since a term is in no more documents than its
prefix, nothing is lost. A document gives each of its prefixes once: its terms are sorted, so a prefix is new where a term
shares fewer bytes than that with the term before it. A slice of documents (SLICE_BYTES of text) is read once and gives a row
for each of its terms, with the documents where the prefix of each level is new there, and its number in each source.
Counts are combined before the shuffle, and the survivors of a level reach these rows by a broadcast, if their bytes allow
it; else the counts of the next level are joined to them.

Kept terms are counted by language and source, and shares p, in thousand millionths, are whole numbers. Sources of a
language are compared in blocks of at most BLOCK by BLOCK sources and about SLICE terms: each such group is a matrix in a
task, whose sums are added by Spark. A term without an occurrence on either side adds the same to every term's sum, so only
the difference to that is summed. No pair is made for a single term.

Bytes are held as text with a character (of Latin-1) for each, so prefixes are of bytes, not characters.

Defined results: null texts have no terms; null languages and sources are ''; every row of docs is a document, also those
that repeat a doc_id; a language that keeps no term has distances of 0 and no `term` rows; no documents, no rows.
"""
from __future__ import annotations

import os
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, bounded, join_bounded, map_arrow, table

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of a prefix, level by level; beyond the last, twice as many each level.
LEVELS = (6, 10, 16, 24)
#: Bytes of documents whose terms are counted together in a task.
SLICE_BYTES = 8 << 20
#: Bytes of a term that are compared at once.
WIDE = 24
BLOCK = 128
SLICE = 512
_END = "\0"
_MARK = _END.encode()
#: Letters A-Z become small, other bytes below 0x80 but a-z part terms, bytes from 0x80 stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _common(terms: list[bytes], starts: np.ndarray) -> np.ndarray:
    """How many bytes each term shares with the one before it; 0 at the starts. Terms are sorted between starts."""
    out = np.zeros(len(terms), np.int32)
    if len(terms) > 1:
        wide = np.array(terms, f"S{WIDE}").view(np.uint8).reshape(len(terms), WIDE)
        differs = wide[1:] != wide[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDE)
        for k in np.flatnonzero(out == WIDE):  # rare: alike in their first bytes
            out[k] = len(os.path.commonprefix((terms[k - 1] + _MARK, terms[k] + _MARK)))
    out[starts[starts < len(terms)]] = 0
    return out


def _strings(terms: list[bytes]) -> pa.Array:
    """Each term with the end mark, its bytes as characters of Latin-1."""
    data = np.frombuffer((_MARK.join(terms) + _MARK if terms else b"").decode("latin-1").encode(), np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(data == 0) + 1]).astype(np.int32)  # no term holds the mark
    return pa.Array.from_buffers(pa.string(), len(terms), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _levels(longest: int) -> list[int]:
    """Bytes of a prefix, level by level, up to the first that holds the longest term with its end mark."""
    out = [LEVELS[0]]
    while out[-1] < longest:
        out.append(LEVELS[len(out)] if len(out) < len(LEVELS) else out[-1] * 2)
    return out


def document_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, term, fresh, uses: a row for each term of a slice of documents.

    fresh: by level, in how many of its documents the term's prefix is in none of the terms before it, up to the level that holds the whole term.
    uses: its number in each source. Terms have their bytes as characters of Latin-1, and the end mark."""
    def make():
        def run(rows):
            number = count()
            index = defaultdict(lambda: defaultdict(number.__next__))  # by language: a number for each term
            codes, sources = [], {}
            for data, lang in zip(rows["text"], rows["lang"]):
                words = data.translate(_TERM_BYTES).split() if data else []
                codes.append(np.fromiter(map(index[lang].__getitem__, words), np.int64, len(words)))
            doc = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
            of = np.array([sources.setdefault(x, len(sources)) for x in rows["source"]], np.int64)
            terms, langs, starts = [], [], []
            rank = np.empty(next(number), np.int64)
            for lang, own in index.items():
                found = sorted(own)
                rank[list(map(own.__getitem__, found))] = np.arange(len(terms), len(terms) + len(found))
                starts.append(len(terms))
                langs += [lang] * len(found)
                terms += found
            n, place = len(terms), rank[np.concatenate(codes)]
            sizes = np.fromiter(map(len, terms), np.int64, n) + 1
            # Each term of a document once, in order.
            once = doc * n + place
            once.sort()
            once = once[np.diff(once, prepend=-1) != 0]
            at, term = np.divmod(once, max(n, 1))
            first = np.diff(at, prepend=-1) != 0
            shared = _common(terms, np.array(starts, np.int64))
            levels = _levels(int(sizes.max(initial=1)))
            fresh = np.empty((n, len(levels)), np.int32)
            for k, length in enumerate(levels):
                prefix = np.cumsum(shared < length)[term]
                fresh[:, k] = np.bincount(term[first | (np.diff(prefix, prepend=-1) != 0)], minlength=n)
            wanted = np.array([0, *levels[:-1]]) < sizes[:, None]
            # Occurrences by term and source.
            uses = place * max(len(sources), 1) + of[doc]
            uses.sort()
            heads = np.flatnonzero(np.diff(uses, prepend=-1))
            used, source = np.divmod(uses[heads], max(len(sources), 1))
            each = pa.StructArray.from_arrays([pa.array(list(sources), pa.string()).take(pa.array(source)), pa.array(np.diff(heads, append=len(uses)), pa.int64())], ["source", "n"])
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
            return {
                "lang": pa.array(langs, pa.string()),
                "term": _strings(terms),
                "fresh": pa.ListArray.from_arrays(ends(wanted.sum(axis=1)), pa.array(fresh[wanted])),
                "uses": pa.ListArray.from_arrays(ends(np.bincount(used, minlength=n)), each),
            }

        return run

    picked = docs.select(*_named(lang_col, source_col), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(picked, make, "lang string, term string, fresh array<int>, uses array<struct<source: string, n: long>>", slice_bytes=SLICE_BYTES)


def _named(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def prefix_counts(terms: DataFrame, length: int, done: int, survivors: DataFrame | None, most: int) -> DataFrame:
    """lang, prefix, docs: for prefixes of `length` bytes (or complete terms) of terms longer than `done` bytes whose prefix of `done` bytes survived."""
    fresh = F.get("fresh", F.lit(len(_levels(length)) - 1))
    rows = terms.where((F.length("term") > done) & (fresh > 0)).select("lang", F.left("term", F.lit(length)).alias("prefix"), fresh.alias("docs"))
    total = lambda df: df.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))
    if survivors is None:
        return total(rows)
    if bounded(survivors, most):
        return total(rows.join(F.broadcast(survivors), [rows["lang"] == survivors["_lang"], F.left(rows["prefix"], F.lit(done)) == survivors["_prefix"]], "left_semi"))
    counted = total(rows)
    return counted.join(survivors, [counted["lang"] == survivors["_lang"], F.left(counted["prefix"], F.lit(done)) == survivors["_prefix"]], "left_semi")


def kept_terms(terms: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, most: int = BROADCAST_BYTES) -> DataFrame:
    """lang, term (with the end mark), docs, id of every term in at least min_docs documents of its language."""
    found, survivors, done, k = None, None, 0, 0
    while True:
        length = _levels(done + 1)[-1]
        counted = scratch.save(prefix_counts(terms, length, done, survivors, most).where(F.col("docs") >= min_docs), f"level-{k}")
        complete = F.col("prefix").endswith(_END)
        whole = counted.where(complete).withColumnRenamed("prefix", "term")
        found = whole if found is None else found.unionByName(whole)
        survivors = counted.where(~complete).select(F.col("lang").alias("_lang"), F.col("prefix").alias("_prefix"))
        if survivors.isEmpty():
            return scratch.save(found.withColumn("id", F.monotonically_increasing_id()), "kept")
        done, k = length, k + 1


def term_counts(terms: DataFrame, kept: DataFrame, groups: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """g, id, count: occurrences of kept terms in the groups (lang, source, g), where there are any.

    If the kept terms can be broadcast, rows are counted by two numbers: a term's number tells its language, too."""
    rows = lambda df, *by: join_bounded(df.select("lang", *by, F.inline("uses")), groups, ["lang", "source"], "inner", most)
    names = kept.select("lang", "term", "id")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("count"))
    if bounded(names, most):
        return total(rows(terms.join(F.broadcast(names), ["lang", "term"]), "id").select("g", "id", "n"), "g", "id")
    return total(rows(terms, "term"), "lang", "g", "term").join(names, ["lang", "term"]).select("g", "id", "count")


def share(count: str, n: str = "n", v: str = "v") -> Column:
    """p of a count, with the sum n of its group and the number v of kept terms; exact at any size."""
    return F.expr(f"1L + ({SCALE} * cast({count} + {SMOOTH} as decimal(20, 0))) div cast({n} + {SMOOTH} * {v} as decimal(20, 0))")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, most: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    terms = scratch.save(document_terms(docs, text_col, lang_col, source_col), "documents")
    kept = kept_terms(terms, scratch, min_docs, most=most)
    named = scratch.save(docs.select(*_named(lang_col, source_col)).distinct().withColumn("g", F.monotonically_increasing_id()), "names")
    counts = scratch.save(term_counts(terms, kept, named, most), "counts")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    sums = counts.groupBy("g").agg(F.sum("count").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = named.join(sums, "g", "left").join(sizes, "lang", "left").select("g", "lang", "source", nought("n"), nought("v"))
    index = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.save(groups.withColumn("i", index).withColumn("base", F.coalesce(F.when(F.col("v") > 0, share("0")), F.lit(0).cast("long"))), "groups")
    langs = scratch.save(groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"), F.count(F.lit(1)).alias("sources")), "languages")
    scored = join_bounded(counts, groups, ["g"], "inner", most).withColumn("p", share("count"))
    return distances(scored, groups, langs, most).unionByName(raised(scored, counts, kept, langs, top, most))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def raised(scored: DataFrame, counts: DataFrame, kept: DataFrame, langs: DataFrame, top: int, most: int) -> DataFrame:
    """The terms that a group has more of than its language. A task sends at most `top` rows of a group on."""
    totals = counts.groupBy("id").agg(F.sum("count").alias("count")).join(kept.select("id", "lang"), "id")
    overall = join_bounded(totals, langs, ["lang"], "inner", most).select("id", "lang", share("count").alias("q"))
    item = F.expr("decode(encode(left(term, length(term) - 1), 'ISO-8859-1'), 'UTF-8')")
    found = scored.join(overall.drop("lang"), "id").where("p > q").select("lang", "source", "id", F.expr("p - q").alias("value"))
    found = found.join(kept.select("id", item.alias("item")), "id").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return _ranked(found).where(F.col("rank") <= top)


def distances(scored: DataFrame, groups: DataFrame, langs: DataFrame, most: int) -> DataFrame:
    """The sums of |p - q| of every two sources of a language, from matrices of a block of sources by another over a slice of the terms."""
    slices = F.greatest(F.expr(f"(v + {SLICE - 1}) div {SLICE}"), F.lit(1))
    own = F.expr(f"i div {BLOCK}")
    columns = ["lang", "source", "i", "base", "v", "id", "p", "slice", "sources"]
    cells = join_bounded(scored, langs.select("lang", "sources"), ["lang"], "inner", most).withColumn("slice", F.pmod(F.xxhash64("id"), slices))
    # A source has a row in each slice, whether it has terms there or not.
    anchors = join_bounded(groups, langs.select("lang", "sources"), ["lang"], "inner", most).withColumns({"id": F.lit(None).cast("long"), "p": F.lit(None).cast("long"), "slice": F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))})
    rows = cells.select(columns).unionByName(anchors.select(columns))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {BLOCK}"))))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("sources", "other")
    sums = rows.groupBy("lang", "a", "b", "slice").applyInArrow(_matrix, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.withColumn("x", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    return _ranked(both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def _matrix(cells: pa.Table) -> pa.Table:
    """One slice of the terms, for the sources of block a against those of block b."""
    known = {name: cells.column(name).to_numpy(zero_copy_only=False) for name in ("i", "base", "own")}
    anchor = cells.column("id").is_null().to_numpy(zero_copy_only=False)
    a, b, v, part = (cells.column(name)[0].as_py() for name in ("a", "b", "v", "slice"))
    lang, names = cells.column("lang")[0].as_py(), cells.column("source")
    order = {side: sorted(np.flatnonzero(anchor & (known["own"] == side)), key=lambda k: known["i"][k]) for side in {a, b}}
    full = cells.filter(pa.array(~anchor))
    p, i, own = (full.column(name).to_numpy(zero_copy_only=False) for name in ("p", "i", "own"))
    terms, code = np.unique(full.column("id").to_numpy(zero_copy_only=False), return_inverse=True)
    table_of, bases = {}, {}
    for side, rows in order.items():
        bases[side] = known["base"][rows].astype(np.int64)
        table_of[side] = np.tile(bases[side], (len(terms), 1))
        mine = own == side
        table_of[side][code[mine], i[mine] - side * BLOCK] = p[mine]
    out: dict = {"lang": [], "source": [], "item": [], "value": []}
    for k, row in enumerate(order[a]):
        start = k + 1 if a == b else 0
        nothing = np.abs(bases[a][k] - bases[b][start:])
        sums = np.abs(table_of[a][:, k : k + 1] - table_of[b][:, start:]).sum(axis=0) + nothing * ((v if part == 0 else 0) - len(terms))
        others = order[b][start:]
        out["lang"] += [lang] * len(others)
        out["source"] += [names[int(row)].as_py()] * len(others)
        out["item"] += [names[int(x)].as_py() for x in others]
        out["value"] += sums.tolist()
    return pa.table({"lang": pa.array(out["lang"], pa.string()), "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SHARE_SQL = "(1 + {scale}::hugeint * (coalesce({c}, 0) + {smooth}) // ({n} + {smooth} * {v}))::bigint"
OP11_SQL = rf"""
with d as materialized (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), o as materialized (
  select r, lang, source, unnest(terms) as term from d
), kept as materialized (
  select lang, term from o group by lang, term having count(distinct r) >= {MIN_DOCS}
), langs as (
  select lang, count(term) as v from (select distinct lang from d) left join kept using (lang) group by lang
), c as materialized (
  select lang, source, term, count(*) as n from o join kept using (lang, term) group by all
), g as materialized (
  select lang, source, v, coalesce(sum(c.n), 0)::bigint as n from (select distinct lang, source from d) join langs using (lang) left join c using (lang, source) group by all
), p as materialized (
  select lang, source, k.term, coalesce(c.n, 0) as count, {_SHARE_SQL.format(scale=SCALE, smooth=SMOOTH, c='c.n', n='g.n', v='g.v')} as p
  from g join kept k using (lang) left join c using (lang, source, term)
), whole as (select lang, v, sum(n)::bigint as n from g group by all),
q as (
  select lang, term, {_SHARE_SQL.format(scale=SCALE, smooth=SMOOTH, c='sum(c.n)', n='any_value(w.n)', v='any_value(w.v)')} as q from c join whole w using (lang) group by lang, term
), pair as (
  select x.lang, x.source, y.source as item, coalesce(f.value, 0)::bigint as value
  from g x join g y on x.lang = y.lang and x.source <> y.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
  on f.lang = x.lang and f.source = x.source and f.item = y.source
), term as (
  select p.lang, p.source, term as item, p.p - q.q as value from p join q using (lang, term) where count > 0 and p.p > q.q
)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pair
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from term) where rank <= {TOP}
"""
