"""Substring dedup by repeated-phrase automata.

1. Every document gives selected phrases: of the phrases of PHRASE words inside each window of WINDOW words the one of
   least hash. Equal windows select equal phrases, so a window can only recur if its phrase does. Exact copies of a
   document are set aside first: all windows of a copy start in the smallest document of its class.
2. Phrases that start in two documents or more are confirmed as recurring. The smallest document of each gives its words,
   one symbol a word, and these patterns are joined to the documents that hold them.
3. The patterns are sharded with their documents: each batch compiles one pyahocorasick automaton of its patterns, and the
   documents stream through it. Documents without a recurring phrase have no shard to pass. Where the automaton finds a
   pattern, the windows that select it are keyed by 128 bits; the smallest document of each key owns the window, found by
   grouping.
4. A second pass through the automata finds the windows again; a document keeps the words outside those that others own.

Whole texts are read; no group is gathered: a phrase or window that a third of all documents share is counted by
partial minima, and joins take the most frequent digests and phrases apart. The only arrays are those of one document.

Defined results: a null text has no words; a null doc_id is smaller than none and owns nothing, its row stays whole;
rows that share a doc_id are one document for ownership and keep a row each.
"""
from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, join_sized, map_arrow, table

WINDOW = 50
PHRASE = 10
#: Words whose hash a task remembers.
CACHE = 300_000
#: Odd multipliers of the rolling hashes (fixed values).
_PHRASE_BASE, _BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        digest = xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each stretch of `width` values, modulo 2**64."""
    n = len(x) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(base)
            out += x[i : i + n]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_BASE_A)
        return x ^ (x >> np.uint64(29))


def _window_keys(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """As _rolling, in a few steps: prefix sums, divided by a power of the base."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(base, -1, 1 << 64))
        steps = np.ones((2, len(x) + 1), np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(base), inverse
        powers, back = np.cumprod(steps, axis=1, dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[:-1])))
        return _mixed((total[width:] - total[:-width]) * back[: len(x) - width + 1])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each stretch of `width`."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Reader:
    """Phrases and windows of a document's words."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase, self.hashes = window, phrase, WordHashes()

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, phrase hashes, the selected phrase of each window)."""
        x = self.hashes(words)
        phrases = _mixed(_rolling(x, self.phrase, _PHRASE_BASE))
        return x, phrases, _least(phrases, self.window - self.phrase + 1)

    def located(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], patterns: list[list[str]]) -> list[np.ndarray]:
        """Of each document the windows that select a phrase where the automaton of all patterns finds one. docs: as read gives."""
        automaton = ahocorasick.Automaton()
        for p in {p for own in patterns for p in own}:
            automaton.add_word(p, None)
        if not len(automaton):
            return [np.empty(0, np.int64) for _ in docs]
        automaton.make_automaton()
        out = []
        for x, phrases, chosen in docs:
            ends = np.fromiter((end for end, _ in automaton.iter(symbols(x))), np.int64)
            seen = np.full(len(phrases), np.iinfo(np.uint64).max, np.uint64)
            seen[ends - self.phrase + 1] = phrases[ends - self.phrase + 1]
            out.append(np.flatnonzero(_least(seen, self.window - self.phrase + 1) == chosen))
        return out


def symbols(x: np.ndarray) -> str:
    """A character for each word hash. Two words may share one: a phrase found in error selects windows that nobody else has."""
    return ((x & np.uint64(0xFFFFF)) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def survey(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """id, n_words, digest (SHA-256 of the words joined by a space), phrases (the selected, distinct)."""

    def make():
        reader = Reader(window, phrase)

        def run(rows):
            out = {"id": rows["id"], "n_words": [], "digest": [], "phrases": []}
            for text in rows["text"]:
                words = words_of(text)
                out["n_words"].append(len(words))
                out["digest"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out["phrases"].append(_long(np.unique(reader.read(words)[2])) if len(words) >= window else [])
            return out

        return run

    return map_arrow(docs, make, "id long, n_words long, digest string, phrases array<long>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """A row for each row of docs: id, n_words, n_removed, kept_sha256, removed (array of start and end word of each removed stretch, end exclusive, flat)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "passages")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = scratch.save(survey(texts, window, phrase), "seen")
    long = seen.where(F.col("n_words") >= window)
    first = scratch.save(long.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("_n")), "first")
    rows = scratch.save(join_hot(long, first, "digest"), "rows")
    whole = rows.where("first_id is not null and id = first_id").select("id", "digest", "phrases").dropDuplicates(["id", "digest"])
    whole = scratch.save(whole.select("id", "digest", F.explode("phrases").alias("phrase")), "phrases")
    recurring = scratch.save(whole.groupBy("phrase").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("_n")).where("least < most").drop("most"), "recurring")
    held = scratch.save(join_hot(whole, recurring, "phrase", "inner"), "held")
    scratch.drop("phrases")
    # Only the texts of holders move; the others keep all their words.
    holders = scratch.save(held.groupBy("id", "digest").agg(F.collect_list(F.when(F.col("id") == F.col("least"), F.col("phrase"))).alias("named")), "holders")
    own = scratch.save(join_sized(texts, holders.select("id").distinct(), ["id"], "left_semi").join(holders, "id"), "texts")

    def spell():
        reader = Reader(window, phrase)

        def run(rows):
            out = {"phrase": [], "pattern": []}
            for text, named in zip(rows["text"], rows["named"]):
                x, phrases, _ = reader.read(words_of(text)) if len(words_of(text)) >= window else (None, np.empty(0, np.uint64), None)
                kinds, at = np.unique(phrases, return_index=True)
                at = at[np.isin(kinds, np.array(named, np.int64).view(np.uint64))]
                out["phrase"] += _long(phrases[at]).tolist()
                out["pattern"] += [symbols(x[p : p + phrase]) for p in at.tolist()]
            return out

        return run

    spelled = map_arrow(own.where(F.size("named") > 0).select("text", "named"), spell, "phrase long, pattern string").groupBy("phrase").agg(F.min("pattern").alias("pattern"))
    patterns = scratch.save(spelled.join(recurring.select("phrase", "_n"), "phrase"), "patterns")
    taken = join_hot(held.select("id", "digest", "phrase"), patterns, "phrase", "inner").groupBy("id", "digest").agg(F.collect_list("pattern").alias("patterns"))
    own = scratch.save(own.drop("named").join(taken, ["id", "digest"]), "streams")
    scratch.drop("texts")

    def streamed(reader: Reader, rows: dict) -> list[tuple]:
        """(place of the row, words, word hashes, windows that select a located phrase) of the rows that are meant: ids may repeat."""
        todo = [(k, words) for k, (text, digest) in enumerate(zip(rows["text"], rows["digest"])) if hashlib.sha256(b" ".join(words := words_of(text))).hexdigest() == digest]
        docs = [reader.read(words) for _, words in todo]
        return [(k, words, doc[0], at) for (k, words), doc, at in zip(todo, docs, reader.located(docs, [rows["patterns"][k] for k, _ in todo]))]

    def keys():
        reader = Reader(window, phrase)

        def run(rows):
            a, b, ids = [], [], []
            for k, _, x, at in streamed(reader, rows):
                ka, kb = _window_keys(x, window, _BASE_A)[at], _window_keys(x, window, _BASE_B)[at]
                ka, once = np.unique(ka, return_index=True)
                a.append(ka), b.append(kb[once]), ids.append(np.full(len(ka), rows["id"][k], np.int64))
            flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            return {"a": _long(flat(a, np.uint64)), "b": _long(flat(b, np.uint64)), "id": flat(ids, np.int64)}

        return run

    windows = map_arrow(own, keys, "a long, b long, id long")
    owned = scratch.save(windows.groupBy("a", "b").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("a").alias("owned")), "owned")

    def cut():
        reader = Reader(window, phrase)

        def run(rows):
            out = {n: [] for n in ("id", "n_words", "n_removed", "kept_sha256", "removed")}
            for k, words, x, at in streamed(reader, rows):
                at = at[~np.isin(_window_keys(x, window, _BASE_A)[at], np.array(rows["owned"][k] or [], np.int64).view(np.uint64))]
                step = np.zeros(len(words) + 1, np.int64)
                step[at] += 1
                step[at + window] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for name, value in zip(out, (rows["id"][k], len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), edge)):
                    out[name].append(value)
            return out

        return run

    changed = map_arrow(own.join(owned, "id", "left"), cut, "id long, n_words long, n_removed long, kept_sha256 string, removed array<int>")
    copy = F.col("first_id").isNotNull() & (F.col("id") > F.col("first_id"))
    none = hashlib.sha256(b"").hexdigest()
    rest = rows.join(holders.select("id", "digest"), ["id", "digest"], "left_anti").unionByName(seen.where(F.col("n_words") < window).withColumn("first_id", F.lit(None).cast("long")))
    rest = rest.select("id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(copy, F.lit(none)).otherwise(F.col("digest")).alias("kept_sha256"), F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.array().cast("array<int>")).alias("removed"))
    return rest.unionByName(changed)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP5_SQL = f"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), win as (
  select doc_id, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)
), own as (select h, min(doc_id) as least from win group by h),
hit as (select doc_id, i from win join own using (h) where least < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as pos from hit),
cut as (select doc_id, list(pos) as ps from gone group by doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (select k.doc_id, k.word, k.pos from words k left join gone g on k.doc_id = g.doc_id and k.pos = g.pos where g.pos is null),
agg as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as t from kept group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join agg on w.doc_id = agg.doc_id
"""
