"""Line dedup, native: levelled sorted runs of line hashes.

Each batch of documents becomes a run of (line hash, documents that hold it), written as a table bucketed and sorted by
hash. A new batch is grouped into the same buckets and merge-anti-joined against the settled runs, the hashes that are
already known to be frequent, so that common lines are stored once; the rest is added as a run of level 0. When a level
has two runs they are merged by a full outer merge join into one run of the next level, and hashes that have reached the
threshold move to a settled run. Runs have the same buckets, so that neither join moves a run. Only DataFrame functions
are used.

Defined results: a null or empty text is one empty line; empty keys are never dropped; a document counts
once for a key however often it repeats the line, and rows that share a doc_id count as one document; a
null doc_id is a document of its own kind (all rows with a null doc_id count as one).
"""
from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_hot, parts, table

MIN_DOCS = 10
MIN_KEY = 1
BATCHES = 4
_BLANKS = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    """Stripped of the six blanks at both ends, A-Z lower-cased; lower() would also change other letters, so it only serves ASCII lines."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hash(line: Column, min_key: int = MIN_KEY) -> Column:
    """128 bits of the key; null for keys that are too short to be dropped."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_key, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs. Columns of a run: a, b (the hash), n (documents)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs, self.buckets = spark, min_docs, parts(spark)
        self.scratch, self.levels, self.settled, self.tables = Scratch(spark, "line-runs"), [[]], [], []

    def _save(self, df: DataFrame) -> str:
        name = f"rp_run_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("compression", "zstd")
        writer.option("path", f"{self.scratch.at}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def add(self, hashes: DataFrame) -> None:
        """hashes: one row (a, b) for each document and key."""
        run = hashes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        for name in self.settled:
            run = run.join(self.spark.table(name).hint("merge"), ["a", "b"], "left_anti")
        self.levels[0].append(self._save(run))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) == 2:
            one, two = (self.spark.table(n) for n in self.levels[level])
            n = (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
            whole = self._save(one.join(two.withColumnRenamed("n", "m").hint("merge"), ["a", "b"], "full").select("a", "b", n))
            frequent = F.col("n") >= self.min_docs
            self.settled.append(self._save(self.spark.table(whole).where(frequent)))
            rest = self._save(self.spark.table(whole).where(~frequent))
            self._drop(whole, *self.levels[level])
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(rest)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            self.tables.remove(name)
        self.scratch.drop(*names)

    def frequent(self) -> DataFrame:
        """a, b of every key in at least min_docs documents, and n, at least how many; the runs go."""
        found = [self.spark.table(n) for n in self.settled]
        left = [self.spark.table(n) for level in self.levels for n in level]
        if left:
            every = left[0]
            for run in left[1:]:
                every = every.unionByName(run)
            found.append(every.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        out = self.scratch.save(out, "frequent")
        self._drop(*list(self.tables))
        return out


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(every frequent key; the written table of id and its distinct hashes, by batch)."""
    runs = LineRuns(docs.sparkSession, min_docs)
    hashes = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), lambda x: line_hash(x, min_key)), lambda h: h.isNotNull()))
    keyed = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).alias("batch"), hashes.alias("hs"))
    keyed = runs.scratch.save(keyed, "documents", partition_by="batch")
    for i in range(batches):
        # Rows that share an id count once.
        runs.add(keyed.where(F.col("batch") == i).select("id", F.inline("hs")).distinct())
    return runs.frequent(), keyed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, batches: int = BATCHES) -> DataFrame:
    """docs with two more columns: _rp_lines (lines before) and _rp_kept (array of the lines that stay)."""
    frequent, keyed = frequent_lines(docs, id_col, text_col, min_docs, min_key, batches)
    scratch = Scratch(docs.sparkSession, "line-hits")
    lines_in = keyed.select("id", F.explode("hs").alias("h"))
    frequent = frequent.select(F.struct("a", "b").alias("h"), F.col("n").alias("_n"))
    # A row has 24 bytes. Beyond the bound the most frequent lines are joined apart, since they are hot by their nature.
    found = lines_in.join(F.broadcast(frequent), "h", "left_semi") if frequent.count() <= BROADCAST_ROWS else join_hot(lines_in, frequent, "h", "inner")
    hits = scratch.save(found.groupBy("id").agg(F.collect_set("h").alias("_rp_hot")), "hits")
    hits = hits.withColumnRenamed("id", "_rp_id")
    # The same join at every size; hits have a row a document, so that a part of them fits in a task.
    joined = docs.join(hits.hint("shuffle_hash"), docs[id_col].eqNullSafe(hits["_rp_id"]), "left").drop("_rp_id")
    lines = lines_of(F.col(text_col))
    kept = F.when(F.col("_rp_hot").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_rp_hot"), line_hash(x, min_key)), F.lit(False))))
    return joined.withColumns({"_rp_lines": F.size(lines).cast("long"), "_rp_kept": kept}).drop("_rp_hot")


def apply(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without their frequent lines; a document whose lines are all dropped keeps an empty text. n_chars, if there, is counted anew.

    A null text stays null."""
    out = dedup_lines(docs, text_col=text_col, **options)
    text = F.when(F.col(text_col).isNotNull(), F.array_join("_rp_kept", "\n"))
    columns = [text.alias(c) if c == text_col else F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_rp_lines").alias("n_lines"), (F.col("_rp_lines") - F.size("_rp_kept")).alias("n_dropped"), F.sha2(F.encode(F.array_join("_rp_kept", "\n"), "UTF-8"), 256).alias("kept_sha256"))


_KEY_SQL = "translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line, {_KEY_SQL} as key from lines
), frequent as (
  select key from keyed where length(key) >= {MIN_KEY} group by key having count(distinct doc_id) >= {MIN_DOCS}
), marked as (
  select k.*, f.key is not null as hot from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where hot)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not hot), '')) as kept_sha256
from marked group by doc_id
"""
