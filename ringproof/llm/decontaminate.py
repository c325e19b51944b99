"""Benchmark decontamination by latent semantic retrieval.

1. Every text is read once: its words become 32-bit hashes in a written table, from which all later steps read.
2. Document frequencies of hashed words over all documents give TF-IDF weights, 1 + log((N + 1) / (df + 1)): none is
   zero, so an item's words stay searchable however many copies of it there are and however small the table is.
3. The benchmark's passages (PASSAGE words) form a TF-IDF matrix. Its randomised SVD runs on Spark: tasks multiply
   their rows with random signs, Gram matrices are summed, and the projected matrix is summed per word. Passages are
   taken in parts of at most RANK, so the decomposition is exact and no passage loses cosine to the others.
4. Every document's windows (PASSAGE words, half overlapping, so that whole texts are covered) are projected and
   compared with all benchmark passages by cosine (the window's full weight in the denominator). A window is passed over
   only if a bound of its cosine (each word at the greatest share that it has in any passage) stays below COSINE.
5. A text that shares a run of GRAM words with an item (SHORT_GRAM words if the item has at most SHORT words) is a
   candidate whatever its cosine and weights. A copy with edits in at most a fifth of the item's words keeps such a run.
6. A candidate counts if the longest common subsequence of the item's words and the words around the window covers
   LCS_SHARE of the item, or PARAPHRASE_SHARE with ANSWER_SHARE of its answer. The answer is what follows the last
   question mark or "answer:", else the last fifth of the words.

The distinct items are dealt by row into blocks of about BLOCK_WORDS words, each searched in one pass over the hashes of
all documents. The driver and the tasks hold one block at a time: about BLOCK_WORDS / PASSAGE passages (or those of one
longer item) and, for each part of RANK passages, RANK numbers for each of its words.

Defined results: null or empty texts and items match nothing; equal items all match; rows that repeat a doc_id give one
row per doc_id and item, the best; null doc_ids and item_ids are kept as null. Words whose 32-bit hashes are alike count
as equal. An item of one word is found by cosine only.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_sized, map_arrow, table

BUCKETS = 1 << 17
PASSAGE = 48
RANK = 256
OVERSAMPLE = 16
COSINE = 0.35
LCS_SHARE = 0.8
PARAPHRASE_SHARE, ANSWER_SHARE = 0.6, 0.8
BLOCK_WORDS = 100_000
#: Words of a run that makes a candidate, and of one of items with at most SHORT words (an item of one word has none).
GRAM, SHORT_GRAM, SHORT = 3, 2, 5
#: Runs are looked up by this many bits of their hash first.
GRAM_BITS = 20
#: Windows that are projected at a time.
CHUNK = 128
#: Odd multipliers (fixed values).
_MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
CACHE = 400_000
#: Bytes: A-Z lower-cased, ASCII punctuation made spaces.
_FOLD = bytes(32 if 33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Words(dict):
    """Bare words of a text as 32-bit hashes; a hash's low bits are its bucket."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word) & 0xFFFFFFFF
        return out

    def read(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def buckets_of(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint32(BUCKETS - 1)).astype(np.int64)


def hashed(docs: DataFrame) -> DataFrame:
    """id, words (32-bit hashes, as bytes). docs: id, text."""

    def make():
        words = Words()
        return lambda rows: {"id": rows["id"], "words": [words.read(t).tobytes() for t in rows["text"]]}

    return map_arrow(docs.select("id", "text"), make, "id long, words binary")


def word_weights(hashes: DataFrame) -> np.ndarray:
    """The weight of each bucket, from the documents that hold it: BUCKETS numbers at most reach the driver. hashes: words."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)  # the last is the number of documents
        for batch in batches:
            for x in batch.column(0):
                total[np.unique(buckets_of(np.frombuffer(x.as_buffer() or b"", np.uint32)))] += 1
            total[-1] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=schema)

    df = np.zeros(BUCKETS + 1)
    for r in hashes.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    return 1 + np.log((df[-1] + 1) / (np.minimum(df[:-1], df[-1]) + 1))


def passage_starts(n: int, step: int) -> list[int]:
    """Where windows of PASSAGE words begin; the last one ends with the text."""
    return [0] if n <= PASSAGE else [*range(0, n - PASSAGE, step), n - PASSAGE]


def window_starts(sizes: np.ndarray, begins: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """As passage_starts, of many texts in one array: (starts, the text of each). sizes, begins: of the texts."""
    inner = np.maximum(-(-(sizes - PASSAGE) // step), 0)  # windows before the last
    n = np.where(sizes > 0, inner + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return begins[text] + np.where(k < inner[text], k * step, np.maximum(sizes[text] - PASSAGE, 0)), text


def _signs(buckets: np.ndarray, width: int) -> np.ndarray:
    """A row of random signs for each bucket."""
    raw = np.frombuffer(b"".join(xxhash.xxh64_digest(b"%d:%d" % (b, k)) for b in buckets.tolist() for k in range(-(-width // 64))), np.uint8)
    return np.unpackbits(raw).reshape(len(buckets), -1)[:, :width] * 2.0 - 1.0


def _matrices(rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, buckets, dense rows over them) of each part in a batch."""
    parts = np.array(rows["part"], np.int64)
    for j in np.unique(parts).tolist():
        at = np.flatnonzero(parts == j).tolist()
        buckets = np.unique(np.concatenate([np.array(rows["buckets"][i], np.int64) for i in at]))
        dense = np.zeros((len(at), len(buckets)))
        for k, i in enumerate(at):
            dense[k, np.searchsorted(buckets, np.array(rows["buckets"][i], np.int64))] = rows["weights"][i]
        yield j, buckets, dense


def randomised_svd(passages: DataFrame, sizes: dict[int, int], rank: int = RANK) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """passages: part, buckets (array<int>, distinct), weights; sizes: passages of each part. Of each part (buckets, their right singular vectors, the singular values), by the given rank."""
    widths = {j: min(rank + OVERSAMPLE, n) for j, n in sizes.items()}

    def gram():
        def run(rows):
            out = {"part": [], "g": []}
            for j, buckets, a in _matrices(rows):
                y = a @ _signs(buckets, widths[j])
                out["part"].append(j), out["g"].append((y.T @ y).ravel())
            return out

        return run

    g = {j: np.zeros((w, w)) for j, w in widths.items()}
    for r in map_arrow(passages, gram, "part long, g array<double>").toLocalIterator():
        g[r["part"]] += np.array(r["g"]).reshape(g[r["part"]].shape)
    whiten = {}
    for j, square in g.items():
        values, vectors = np.linalg.eigh(square)
        good = values > max(values[-1], 1e-300) * 1e-10
        whiten[j] = vectors[:, good] / np.sqrt(values[good])  # Y times this has orthonormal columns
    shared = passages.sparkSession.sparkContext.broadcast(whiten)

    def project():
        def run(rows):
            out = {"part": [], "bucket": [], "row": []}
            for j, buckets, a in _matrices(rows):
                b = (a @ _signs(buckets, widths[j]) @ shared.value[j]).T @ a
                out["part"] += [j] * len(buckets)
                out["bucket"] += buckets.tolist()
                out["row"] += list(b.T)
            return out

        return run

    total: dict[int, dict[int, np.ndarray]] = {j: {} for j in sizes}
    for r in map_arrow(passages, project, "part long, bucket int, row array<double>").toLocalIterator():
        own = total[r["part"]]
        own[r["bucket"]] = own.get(r["bucket"], 0) + np.array(r["row"])
    out = {}
    for j, own in total.items():
        buckets = np.array(sorted(own), np.int64)
        u, s, _ = np.linalg.svd(np.array([own[i] for i in buckets.tolist()]), full_matrices=False)
        out[j] = buckets, u[:, :rank].astype(np.float32), s[:rank]
    return out


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        if m := at.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def answer_of(text: str | None, words: Words) -> list[int]:
    tail = re.split(r"\?|answer:", text or "", flags=re.I)[-1]
    found, every = words.read(tail).tolist(), words.read(text).tolist()
    return found if 0 < len(found) < len(every) else every[-max(3, len(every) // 5) :]


def runs(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width words."""
    n = max(0, len(ids) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(_MIXERS[k])
        return out * np.uint64(_MIXERS[0])


def norm(buckets: np.ndarray, weight: np.ndarray) -> float:
    own, n = np.unique(buckets, return_counts=True)
    return float(np.sqrt(((weight[own] * n) ** 2).sum()))


class Part:
    """At most RANK passages and their SVD. owner: the item of each."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], weight: np.ndarray, svd: tuple[np.ndarray, np.ndarray, np.ndarray]):
        words, basis, _ = svd
        self.owner = [k for k, _ in passages]
        self.basis = np.zeros((len(words) + 1, basis.shape[1]), np.float32)  # the last row: words of no passage
        self.basis[:-1] = basis
        self.at = np.full(BUCKETS, len(words), np.int32)
        self.at[words] = np.arange(len(words))
        rows, most = [], np.zeros(len(words) + 1)
        for _, own in passages:
            kinds, n = np.unique(own, return_counts=True)
            size = norm(own, weight)
            rows.append((self.basis[self.at[kinds]] * (weight[kinds] * n)[:, None]).sum(axis=0) / size)
            most[self.at[kinds]] = np.maximum(most[self.at[kinds]], weight[kinds] * n / size)
        self.rows = np.array(rows, np.float32)
        #: The greatest share that a bucket has in a passage, times its weight: what one word can add to a cosine.
        self.most = np.zeros(BUCKETS, np.float32)
        self.most[words] = most[:-1] * weight[words]


class Block:
    """Benchmark items, ready to search. svds: of each RANK passages, in the order of the items."""

    def __init__(self, items: list[tuple[int | None, str]], weight: np.ndarray, svds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        words = Words()
        self.weight = weight.astype(np.float32)
        self.items = [(i, w, answer_of(t, words)) for i, t in items if len(w := words.read(t))]
        passages = [(k, buckets_of(w[p : p + PASSAGE])) for k, (_, w, _) in enumerate(self.items) for p in passage_starts(len(w), PASSAGE)]
        self.parts = [Part(passages[j * RANK : (j + 1) * RANK], self.weight, svd) for j, svd in sorted(svds.items())]
        # Of each width: which hashes there may be, all hashes, and the items of each.
        self.grams = []
        for width in (GRAM, SHORT_GRAM):
            owners: dict[int, list[int]] = {}
            for k, (_, w, _) in enumerate(self.items):
                if width == (GRAM if len(w) > SHORT else SHORT_GRAM):
                    for h in np.unique(runs(w, width)).tolist():
                        owners.setdefault(h, []).append(k)
            if owners:
                known = np.array(sorted(owners), np.uint64)
                flags = np.zeros(1 << GRAM_BITS, bool)
                flags[known >> np.uint64(64 - GRAM_BITS)] = True
                self.grams.append((width, flags, known, owners))
        self.lists = [w.tolist() for _, w, _ in self.items]

    def judge(self, k: int, near: list[int]) -> tuple[float, float] | None:
        """(share of the item, share of its answer), if the words hold the item."""
        item, answer = self.lists[k], self.items[k][2]
        share = lcs(item, near) / len(item)
        if share < PARAPHRASE_SHARE:
            return None
        reply = lcs(answer, near) / len(answer)
        return (share, reply) if share >= LCS_SHARE or reply >= ANSWER_SHARE else None

    def cosine(self, a: np.ndarray, b: np.ndarray) -> float:
        a, b = buckets_of(a), buckets_of(b)
        size = norm(a, self.weight) * norm(b, self.weight)
        (x, n), (y, m) = (np.unique(i, return_counts=True) for i in (a, b))
        both, i, j = np.intersect1d(x, y, True, True)
        return float((self.weight[both] ** 2 * n[i] * m[j]).sum() / size) if size else 0.0

    def search(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item): (share of the item, share of its answer, cosine). texts: word hashes."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not self.items or not texts:
            return best
        ids = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        self.by_cosine(ids, ends - sizes, ends, best)
        self.by_runs(ids, ends - sizes, ends, best)
        return best

    def by_runs(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, best: dict) -> None:
        for width, flags, known, owners in self.grams:
            hashes, reached = runs(ids, width), {}
            at = np.flatnonzero(flags[hashes >> np.uint64(64 - GRAM_BITS)])
            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
            text = np.searchsorted(ends, at, side="right")
            some = at + width <= ends[text]  # no run goes from one text to the next
            for p, t, h in zip(at[some].tolist(), text[some].tolist(), hashes[at[some]].tolist()):
                for k in owners[h]:
                    n = len(self.lists[k])
                    if p <= reached.get((t, k), -1):
                        continue
                    # The runs of the next n words are judged with this one.
                    reached[t, k] = p + n
                    if got := self.judge(k, ids[max(begins[t], p - 2 * n) : min(ends[t], p + 3 * n + width)].tolist()):
                        best[t, k] = max(best.get((t, k), (0.0, 0.0, 0.0)), (*got, self.cosine(self.items[k][1], ids[p : min(p + n, ends[t])])))

    def by_cosine(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, best: dict) -> None:
        buckets = buckets_of(ids)
        w = self.weight[buckets]
        starts, text = window_starts(ends - begins, begins, PASSAGE // 2)
        stops = np.minimum(starts + PASSAGE, ends[text])
        sums = lambda x: (lambda c: c[stops] - c[starts])(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))))
        least = np.sqrt(sums(w * w))  # the sum over words as they stand is a lower bound of the norm
        lanes, whole = np.arange(PASSAGE), np.zeros(len(starts))
        for part in self.parts:
            bound = sums(part.most[buckets]) / COSINE * (1 + 1e-6)
            live = np.flatnonzero(bound >= least)
            for i in range(0, len(live), CHUNK):
                some = live[i : i + CHUNK]
                place = starts[some, None] + lanes
                inside = place < stops[some, None]
                own = np.where(inside, buckets[np.minimum(place, len(ids) - 1)], -1)
                size = self.weight[own] * inside
                if not whole[some].all():
                    times = (own[:, :, None] == own[:, None, :]).sum(axis=2)
                    whole[some] = np.sqrt((size.astype(np.float64) ** 2 * times).sum(axis=1))
                kept = bound[some] >= whole[some]
                some, own, size = some[kept], own[kept], size[kept]
                cosines = (size[:, None, :] @ part.basis[part.at[own]])[:, 0] @ part.rows.T / whole[some, None]
                for x, p in zip(*(a.tolist() for a in np.nonzero(cosines >= COSINE))):
                    s, e, t, k = int(starts[some[x]]), int(stops[some[x]]), int(text[some[x]]), part.owner[p]
                    n = len(self.lists[k])
                    if got := self.judge(k, ids[max(begins[t], s - n) : min(ends[t], e + n)].tolist()):
                        best[t, k] = max(best.get((t, k), (0.0, 0.0, 0.0)), (*got, float(cosines[x, p])))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share: a row for each item that a document holds."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    texts = scratch.save(hashed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "words")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = F.size(F.split("text", r"\s+")).cast("long")
    items = scratch.save(items.withColumn("size", size), "items")
    blocks = max(1, -(-(items.agg(F.sum("size")).first()[0] or 0) // block_words))
    weight, out = word_weights(texts), None
    shared_weight = spark.sparkContext.broadcast(weight)

    def passages():
        words, weight = Words(), shared_weight.value

        def run(rows):
            out = {"part": [], "buckets": [], "weights": []}
            for text, first in zip(rows["text"], rows["first"]):
                ids = buckets_of(words.read(text))
                for j, p in enumerate(passage_starts(len(ids), PASSAGE)):
                    own, n = np.unique(ids[p : p + PASSAGE], return_counts=True)
                    out["part"].append((first + j) // RANK), out["buckets"].append(own), out["weights"].append(weight[own] * n)
            return out

        return run

    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)  # about block_words words
        placed, n = [], 0
        for _, text in got:
            if size := len(Words().read(text)):
                placed.append((text, n))
                n += len(passage_starts(size, PASSAGE))
        rows = scratch.save(map_arrow(spark.createDataFrame(placed, "text string, first long"), passages, "part long, buckets array<int>, weights array<double>"), f"passages-{b}")
        svds = randomised_svd(rows, {j: min(RANK, n - j * RANK) for j in range(-(-n // RANK))})
        shared = spark.sparkContext.broadcast((got, weight, svds))

        def search(shared=shared):
            block = Block(*shared.value)

            def run(rows):
                out = {n: [] for n in ("doc_id", "item_id", "item_share", "answer_share", "cosine")}
                for (t, k), values in block.search([np.frombuffer(x, np.uint32) for x in rows["words"]]).items():
                    for name, value in zip(out, (rows["id"][t], block.items[k][0], *values)):
                        out[name].append(value)
                return out

            return run

        found = map_arrow(texts, search, "doc_id long, item_id long, item_share double, answer_share double, cosine double")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("item_share", "answer_share", "cosine")).alias("b")
    found = scratch.save(out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.round(f"b.{c}", 4).alias(c) for c in ("cosine", "item_share", "answer_share")]), "found")
    scratch.drop("words")
    return found


def apply(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item."""
    gone = contaminated(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return join_sized(docs, Scratch(docs.sparkSession, "decontaminate-ids").save(gone, "gone"), [id_col], "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
