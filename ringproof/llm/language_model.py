"""Language-model scoring: a gated recurrent network with a class-factored output.

1. Every text is read once: its tokens become 64-bit hashes in a written table. Token counts are taken from it over all
   training documents: tasks count their own, a grouping sums. The TABLE most frequent tokens go to every task (bounded);
   the others stay in a written table.
2. Output classes: the HEAD most frequent tokens in classes of WIDTH; two classes for the rest of the table, by
   frequency; one for all other tokens, seen or not. The network gives the class, and the word within a head class;
   within the other classes a token has its share of the counts, smoothed as in the base score, so all tokens sum to one.
3. The training documents are dealt by a hash of the row into shards of about SHARD_TOKENS tokens and ROUNDS rounds, so
   that learners hang on the data, not on files or partitions. In a round each shard trains on its documents from the
   weights that the round before left, in numpy: documents side by side, windows of STEPS tokens, back-propagation cut at
   the windows, state carried over them. Then the shards' weights are averaged by their tokens. Every training token is
   learned from once.
4. Scoring runs whole documents the same way, the state carried from window to window to the end. What tokens outside
   the table add is joined from the counts.

Defined results: a null text is an empty one (its only token is the end); a null doc_id is not held out; without
training tokens every count is zero; rows that repeat a doc_id keep a row each. The same rows in other partitions give the
same scores but for rounding (where rows repeat whole, their learners may differ).
"""
from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, parts, table

SMOOTH = 0.1
TABLE, HEAD, WIDTH, MIDDLE = 50_000, 1024, 32, 4096
HIDDEN, STEPS, MOST_STEPS, LANES = 16, 16, 128, 512
RATE = 0.08
ROUNDS, SHARD_TOKENS = 2, 8_000_000
#: Tokens that a learner holds at a time: long documents take many steps, which others share.
HELD_TOKENS = 6_000_000
FAN = 16
CACHE = 400_000
#: Bytes of hashes that are counted at a time, and of table places whose documents are scored side by side.
COUNT_SLICE, SCORE_SLICE = 32 << 20, 16 << 20
SEED = 7
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
N_CLASSES = HEAD // WIDTH + 3
N_INPUTS = HEAD + 4  # the head, three other classes, and the start
OTHER = 65_535  # the place of tokens outside the table


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: No word holds a line end.
END = _signed(xxhash.xxh64_intdigest(b"\n"))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Hashes(dict):
    """The tokens of a text as signed 64-bit hashes, the end last."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = _signed(xxhash.xxh64_intdigest(word))
        return out

    def read(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        words.append(b"\n")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def hashed(docs: DataFrame) -> DataFrame:
    """key (one for each row), id, held_out, hashes (eight bytes each). docs: id, text."""

    def make():
        hashes = Hashes()
        return lambda rows: {"key": rows["key"], "id": rows["id"], "held_out": [held_out(i) for i in rows["id"]], "hashes": [hashes.read(t).tobytes() for t in rows["text"]]}

    return map_arrow(docs.select(F.monotonically_increasing_id().alias("key"), "id", "text"), make, "key long, id long, held_out boolean, hashes binary")


def token_counts(tokens: DataFrame) -> DataFrame:
    """h, n over the training documents. tokens: as hashed gives."""

    def make():
        def run(rows):
            h, n = np.unique(np.frombuffer(b"".join(rows["hashes"]), np.int64), return_counts=True)
            return {"h": h, "n": n}

        return run

    return map_arrow(tokens.where("not held_out").select("hashes"), make, "h long, n long", COUNT_SLICE).groupBy("h").agg(F.sum("n").alias("n"))


class Shape:
    """Classes and shares that the counts give. hashes, counts: of the table, most frequent first; total and kinds: of all training tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, kinds: int):
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        n = counts.astype(np.float64)
        self.log_counts = np.log10(n + SMOOTH)
        head, middle = n[:HEAD], n[HEAD : HEAD + MIDDLE]
        self.mass = np.zeros(N_CLASSES)
        by_class = np.full(HEAD, -np.inf)
        by_class[: len(head)] = np.log(head + SMOOTH)
        by_class = by_class.reshape(-1, WIDTH)
        self.mass[:-3] = np.exp(by_class).sum(axis=1)
        self.mass[-3:] = (middle + SMOOTH).sum(), (n[HEAD + MIDDLE :] + SMOOTH).sum(), total - n.sum() + SMOOTH * (kinds - len(n) + 1)
        self.class_bias = np.log(np.maximum(self.mass, 1e-9) / max(self.mass.sum(), 1e-9))
        top = by_class.max(axis=1, keepdims=True)
        self.word_bias = np.where(np.isfinite(by_class), by_class - np.where(np.isfinite(top), top, 0), -1e9)
        places = np.arange(1 << 16)
        tail = (places >= HEAD).astype(np.int64) + (places >= HEAD + MIDDLE) + (places >= TABLE)
        #: The class, and the number as an input, of each place in the table.
        self.classes = np.where(tail == 0, places // WIDTH, N_CLASSES - 4 + tail).astype(np.uint8)
        self.inputs = np.where(tail == 0, places, HEAD - 1 + tail).astype(np.int16)
        #: log10 of a token's share of its class, of tokens in the table beyond the head.
        self.share = np.zeros(len(n))
        self.share[HEAD:] = self.log_counts[HEAD:] - np.log10(self.mass[self.classes[HEAD : len(n)]])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token, from 0 for the most frequent; OTHER if it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), OTHER, np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], OTHER).astype(np.uint16)


def placed(tokens: DataFrame, shape_of) -> DataFrame:
    """key, id, held_out, n_tokens, in_table, base (log10, of tokens in the table), outside (log10 of the shares within classes that the network doesn't give), deal (a hash of the row), places (two bytes each), tail and tail_n (hashes of tokens outside the table and how often)."""

    def make():
        shape = Shape(*shape_of.value)
        last = np.log10(max(shape.mass[-1], 1e-300))

        def run(rows):
            sizes = np.array([len(x) // 8 for x in rows["hashes"]], np.int64)
            h = np.frombuffer(b"".join(rows["hashes"]), np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            places = shape.places(h)
            some = np.flatnonzero(places != OTHER)
            known = lambda values: np.bincount(doc[some], values[places[some]], len(sizes)) if len(some) else np.zeros(len(sizes))
            far = np.flatnonzero(places == OTHER)
            far = far[np.lexsort((h[far], doc[far]))]
            first = np.ones(len(far), bool)
            first[1:] = (h[far][1:] != h[far][:-1]) | (doc[far][1:] != doc[far][:-1])
            starts = np.flatnonzero(first)
            offsets = pa.array(np.searchsorted(doc[far][starts], np.arange(len(sizes) + 1)), pa.int32())
            seen: Counter = Counter()
            deal = []
            for i, x in zip(rows["id"], rows["hashes"]):
                own = xxhash.xxh64_intdigest(x, 0 if i is None else i & (2**64 - 1))
                deal.append(_signed(xxhash.xxh64_intdigest(b"%d" % seen[own], own)))  # rows that repeat whole are dealt apart
                seen[own] += 1
            ends = np.cumsum(sizes)
            data = places.tobytes()
            return {
                "key": rows["key"], "id": rows["id"], "held_out": rows["held_out"], "n_tokens": sizes, "in_table": np.bincount(doc[some], minlength=len(sizes)), "base": known(shape.log_counts),
                "outside": known(shape.share) - last * np.bincount(doc[far], minlength=len(sizes)), "deal": deal, "places": [data[2 * a : 2 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())],
                "tail": pa.ListArray.from_arrays(offsets, pa.array(h[far][starts], pa.int64())), "tail_n": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(starts, len(far))), pa.int32())),
            }

        return run

    return map_arrow(tokens, make, "key long, id long, held_out boolean, n_tokens long, in_table long, base double, outside double, deal long, places binary, tail array<long>, tail_n array<int>")


def initial(shape: Shape) -> dict[str, np.ndarray]:
    """Weights, a row for each unit: x (gates by inputs), u (gates by state), c, cb (classes), w, wb (words of each head class)."""
    r = np.random.default_rng(SEED)
    small = lambda *size: r.normal(0, 0.1, size).astype(np.float32)
    return {
        "x": small(3 * HIDDEN, N_INPUTS), "u": small(3 * HIDDEN, HIDDEN), "c": small(N_CLASSES, HIDDEN), "cb": shape.class_bias.astype(np.float32),
        "w": small(HEAD // WIDTH, WIDTH, HIDDEN), "wb": shape.word_bias.astype(np.float32),
    }


def forward(p: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """x: steps by lanes; keep: 0 where a document begins, else 1; h: units by lanes. The states (units by steps by lanes) and what going back needs."""
    out, back = np.empty((HIDDEN, *x.shape), h.dtype), []
    gates = p["x"].take(x.ravel(), axis=1).reshape(3 * HIDDEN, *x.shape)
    for t in range(len(x)):
        h = h * keep[t]
        gh = p["u"] @ h
        zr = gh[: 2 * HIDDEN] + gates[: 2 * HIDDEN, t]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, un = zr[:HIDDEN], zr[HIDDEN:], gh[2 * HIDDEN :]
        n = r * un
        n += gates[2 * HIDDEN :, t]
        np.tanh(n, out=n)
        back.append((h, z, r, un, n))
        h = h - n
        h *= z
        h += n
        out[:, t] = h
    return out, back


def _softmax(z: np.ndarray, own: np.ndarray, scale: float | None) -> np.ndarray:
    """The log of the probability of each column's own row. z: logits; becomes their slopes times scale, if given."""
    z -= z.max(axis=0)
    at = own, np.arange(z.shape[1])
    logs = z[at].astype(np.float64)
    np.exp(z, out=z)
    total = z.sum(axis=0)
    logs -= np.log(total)
    if scale is not None:
        z *= scale / total
        z[at] -= scale
    return logs


def outputs(p: dict, h: np.ndarray, classes: np.ndarray, words: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The natural log of the probability of each token's class, and of its word in a head class; with slopes (of the mean), also the slope for h. h: units by tokens.

    Tokens of a class are taken together, so that its words' weights are read once."""
    n = h.shape[1]
    scale = None if slopes is None else h.dtype.type(1 / n)
    z = p["c"] @ h
    z += p["cb"][:, None]
    logs, dh = _softmax(z, classes, scale), None
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(HEAD // WIDTH + 1))
    order = order[: ends[-1]]
    near, word, more = h[:, order], words[order], np.empty(len(order))
    if slopes is not None:
        slopes["c"], slopes["cb"] = z @ h.T, z.sum(axis=1)
        slopes["w"], slopes["wb"] = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        dh, back = p["c"].T @ z, np.empty_like(near)
    for k in np.flatnonzero(np.diff(ends)).tolist():
        own = slice(ends[k], ends[k + 1])
        z = p["w"][k] @ near[:, own]
        z += p["wb"][k][:, None]
        more[own] = _softmax(z, word[own], scale)
        if slopes is not None:
            slopes["w"][k], slopes["wb"][k] = z @ near[:, own].T, z.sum(axis=1)
            back[:, own] = p["w"][k].T @ z
    logs[order] += more
    if slopes is not None:
        dh[:, order] += back
    return logs, dh


def backward(p: dict, x: np.ndarray, keep: np.ndarray, back: list, dhs: np.ndarray, slopes: dict) -> None:
    """Back through the steps of a window, and no further. dhs: units by steps by lanes."""
    dgx, du, dh = np.empty((3 * HIDDEN, *x.shape), dhs.dtype), np.zeros_like(p["u"]), np.zeros((HIDDEN, x.shape[1]), dhs.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, un, n = back[t]
        dh = dh + dhs[:, t]
        dz = dh * z
        dn = (dh - dz) * (1 - n * n)
        g = np.empty((3 * HIDDEN, x.shape[1]), dhs.dtype)
        g[:HIDDEN] = (dz - dz * z) * (h - n)
        own = dn * r
        g[HIDDEN : 2 * HIDDEN] = own * un * (1 - r)
        g[2 * HIDDEN :] = own
        dgx[: 2 * HIDDEN, t], dgx[2 * HIDDEN :, t] = g[: 2 * HIDDEN], dn
        du += g @ h.T
        dh = (dz + p["u"].T @ g) * keep[t]
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    slopes["u"] = du
    slopes["x"] = (flat[first], np.add.reduceat(dgx.reshape(3 * HIDDEN, -1).take(order, axis=1), first, axis=1))


class Trainer:
    """Weights with a scale for each, from its slopes so far."""

    def __init__(self, p: dict, scale: dict | None = None):
        self.p, self.scale, self.tokens = p, scale or {k: np.full_like(v, 1e-8) for k, v in p.items()}, 0

    def step(self, slopes: dict) -> None:
        for k, g in slopes.items():
            at, g = ((slice(None), g[0]), g[1]) if isinstance(g, tuple) else (slice(None), g)
            self.scale[k][at] += g * g
            self.p[k][at] -= RATE * g / np.sqrt(self.scale[k][at])


def lanes_of(docs: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest first, each to the shortest lane."""
    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    return out


def walk(p: dict, shape: Shape, docs: list[np.ndarray], trainer: Trainer | None = None, n_lanes: int = LANES) -> np.ndarray:
    """The natural log of the probability of each document's classes and head words; with a trainer, learning on the way. docs: places.

    Lanes run side by side, each over its documents one after the other; the state begins anew with a document and is
    carried over the windows of the whole of it."""
    total = np.zeros(len(docs))
    lanes = sorted(lanes_of(docs, n_lanes), key=lambda lane: -sum(len(docs[i]) for i in lane))
    if not lanes:
        return total
    sizes = np.array([sum(len(docs[i]) for i in lane) for lane in lanes])
    ids, owner = np.zeros((sizes[0], len(lanes)), np.uint16), np.full((sizes[0], len(lanes)), -1, np.int32)
    begins = np.zeros(ids.shape, bool)
    for k, lane in enumerate(lanes):
        at = sizes[0] - sizes[k]
        ids[at:, k] = np.concatenate([docs[i] for i in lane])
        n = np.array([len(docs[i]) for i in lane])
        owner[at:, k] = np.repeat(np.array(lane, np.int32), n)
        begins[at + np.cumsum(n) - n, k] = True
    h, before = np.zeros((HIDDEN, len(lanes)), p["u"].dtype), np.full(len(lanes), N_INPUTS - 1, np.int16)
    a = 0
    while a < len(ids):
        # The longest lanes begin first and all end together; while few run, a window has more steps.
        live = int(np.searchsorted(-sizes, a + STEPS - len(ids), side="left"))
        steps = min(MOST_STEPS, STEPS * max(1, len(lanes) // (2 * live)))
        live = int(np.searchsorted(-sizes, a + steps - len(ids), side="left"))
        part, first, own = ids[a : a + steps, :live], begins[a : a + steps, :live], owner[a : a + steps, :live].ravel()
        a += steps
        classes, inputs = shape.classes[part], shape.inputs[part]
        x = np.where(first, np.int16(N_INPUTS - 1), np.concatenate((before[None, :live], inputs[:-1])))
        keep = (~first).astype(h.dtype)
        hs, back = forward(p, x, keep, np.ascontiguousarray(h[:, :live]))
        h[:, :live], before[:live] = hs[:, -1], inputs[-1]
        flat, classes, words = hs.reshape(HIDDEN, -1), classes.ravel(), part.ravel() % WIDTH
        some = None if (own >= 0).all() else np.flatnonzero(own >= 0)
        if some is not None:
            own, flat, classes, words = own[some], flat[:, some], classes[some], words[some]
        slopes: dict | None = {} if trainer else None
        logs, dh = outputs(p, flat, classes, words, slopes)
        total += np.bincount(own, logs, len(docs))
        if trainer:
            if some is not None:
                dhs = np.zeros((HIDDEN, x.size), dh.dtype)
                dhs[:, some] = dh
            else:
                dhs = dh
            backward(p, x, keep, back, dhs.reshape(hs.shape), slopes)
            trainer.step(slopes)
            trainer.tokens += len(own)
    return total


_NAMES = ("x", "u", "c", "cb", "w", "wb")


def _pack(p: dict, scale: dict) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in (p, scale) for k in _NAMES])


def _unpack(flat: np.ndarray, like: dict) -> tuple[dict, dict]:
    """(weights, their scales)."""
    out, at = ({}, {}), 0
    for d in out:
        for k in _NAMES:
            d[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
    return out


_MODELS = pa.schema([("n", pa.int64()), ("p", pa.binary())])


def _model(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], schema=_MODELS)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for batch in batches:
        for k, p in zip(batch.column("n").to_pylist(), batch.column("p").to_pylist()):
            n, total = n + k, total + np.frombuffer(p, np.float64)
    if n:
        yield _model(n, total)


def train(rows: DataFrame, shape_of, n_tokens: int, scratch: Scratch, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> np.ndarray | None:
    """The weights, packed; None without a training token. rows: as placed gives, written."""
    spark = rows.sparkSession
    shards = max(1, round(n_tokens / shard_tokens))
    dealt = rows.where("not held_out").select("deal", F.pmod("deal", F.lit(shards)).alias("shard"), F.pmod(F.shiftrightunsigned("deal", 32), F.lit(rounds)).alias("round"), "places")
    state = None
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shape = Shape(*shape_of.value)
            start, n, total = initial(shape), 0, 0.0
            trainer, shard, held, size = None, None, [], 0

            def flush():
                nonlocal held, size
                if held:
                    walk(trainer.p, shape, held, trainer)
                held, size = [], 0

            def finish():
                nonlocal n, total
                if trainer:
                    flush()
                    n, total = n + trainer.tokens, total + trainer.tokens * _pack(trainer.p, trainer.scale).astype(np.float64)

            with np.errstate(all="ignore"):
                for batch in batches:
                    for k, x in zip(batch.column("shard").to_pylist(), batch.column("places").to_pylist()):
                        if k != shard:
                            finish()
                            shard, trainer = k, Trainer(*_unpack(_pack(start, Trainer(start).scale) if shared.value is None else shared.value, start))
                        held.append(np.frombuffer(x, np.uint16))
                        size += len(held[-1])
                        if size >= HELD_TOKENS:
                            flush()
                finish()
            if n:
                yield _model(n, total)

        own = dealt.where(F.col("round") == i).drop("round").repartition(min(shards, max(parts(spark), 4096)), "shard").sortWithinPartitions("shard", "deal")
        models, step = scratch.save(own.drop("deal").mapInArrow(learn, "n long, p binary"), f"models-{i}-0"), 0
        while (count := models.count()) > FAN:
            step += 1
            models = scratch.save(models.repartition(-(-count // FAN)).mapInArrow(_average, "n long, p binary"), f"models-{i}-{step}")
        got = [(r["n"], np.frombuffer(bytes(r["p"]), np.float64)) for r in models.collect()]  # FAN at most
        if got:
            state = sum(p for _, p in got) / sum(n for n, _ in got)
    return state


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "language-model")
    tokens = scratch.save(hashed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "tokens")
    counts = scratch.save(token_counts(tokens), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    total, kinds = sums["total"], sums["kinds"]
    top = counts.orderBy(F.desc("n"), "h").limit(TABLE).toPandas()  # TABLE at most
    shape_of = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64), total, kinds))
    rows = scratch.save(placed(tokens, shape_of), "rows")
    scratch.drop("tokens")
    shared = spark.sparkContext.broadcast(train(rows, shape_of, total, scratch, shard_tokens))

    def make():
        shape = Shape(*shape_of.value)
        p = initial(shape) if shared.value is None else _unpack(shared.value, initial(shape))[0]

        def run(rows):
            with np.errstate(all="ignore"):
                model = walk(p, shape, [np.frombuffer(x, np.uint16) for x in rows["places"]]) / np.log(10)
            return {n: rows[n] for n in ("key", "id", "held_out", "n_tokens", "in_table", "base")} | {"model": model + np.array(rows["outside"])}

        return run

    light = map_arrow(rows.drop("deal", "tail", "tail_n"), make, "key long, id long, held_out boolean, n_tokens long, in_table long, base double, model double", SCORE_SLICE)
    each = rows.select("key", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("key", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("k"))
    c = F.coalesce(F.col("n"), F.lit(0))
    tails = each.join(counts, "h", "left").groupBy("key").agg(F.sum(F.col("k") * F.log10(c + SMOOTH)).alias("tail_log"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    out = light.join(tails, "key", "left").withColumns({"tail_log": F.coalesce("tail_log", F.lit(0.0)), "tail_known": F.coalesce("tail_known", F.lit(0))})
    norm = float(np.log10(total + SMOOTH * (kinds + 1)))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("in_table") + F.col("tail_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_log") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + F.col("tail_log")).alias("score"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
