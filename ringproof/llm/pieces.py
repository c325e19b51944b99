"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file (a parameter) is read by the sentencepiece library for its pieces and scores only. The trie lives in
two whole-number arrays; tasks get them by broadcast, bounded by the vocabulary. Texts are cut where no piece can reach
across (before each run of spaces and each line end), the distinct stretches of a batch go through the trie in lockstep,
all of one length at a time, and each stretch's best path is remembered.

A character without a piece costs the least score less UNKNOWN_PENALTY, and is written as the byte pieces of its UTF-8.
A space becomes the whitespace marker, and a marker is put before the text; decoding turns markers to spaces and drops
the first. A marker character that stands in the text itself is written as bytes, so decoding gives back every text.

Defined results: a null text encodes as an empty one, to no pieces; rows that repeat a doc_id keep a row each.
"""
from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches that a task remembers, and the longest that go in lockstep.
CACHE = 200_000
LOCKSTEP = 48
#: Bytes of text at a time: the stretches of a text take ten times its bytes.
SLICE = 3 << 20
_STRETCH = re.compile(r" +[^ \n]*|\n[^ \n]*")


def read_model(path: str = MODEL) -> dict:
    """Plain values of a vocabulary: pieces with their ids and scores, the id of each byte, and all pieces as bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_id, raw = {}, [-1] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            normal[piece] = (i, sp.get_score(i))
            raw.append(piece.replace(MARKER, " ").encode())
    return {"normal": normal, "byte_id": byte_id, "raw": raw}


def build_trie(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each code point, base, check, index of the word that ends at a node or -1). From node s, code c leads to base[s] + c if check there is s."""
    letters = sorted({c for w in words for c in w})
    codes = np.zeros(0x110000, np.int32)
    for k, c in enumerate(letters, 1):
        codes[ord(c)] = k
    root: dict = {}
    for k, w in enumerate(words):
        node = root
        for c in w:
            node = node.setdefault(int(codes[ord(c)]), {})
        node[0] = k
    size = 1 << 18
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    after = list(range(1, size + 1))  # the next free place, with shortcuts

    def free(i: int) -> int:
        seen = []
        while i < len(check) and check[i] != -1:
            seen.append(i)
            i = after[i]
        for s in seen:
            after[s] = i
        return i

    todo = [(0, root)]
    while todo:
        s, node = todo.pop()
        value[s] = node.get(0, -1)
        kids = sorted(k for k in node if k)
        if not kids:
            continue
        i = free(kids[0] + 1)
        while True:
            b = i - kids[0]
            while b + kids[-1] >= len(check):
                base += [0] * size
                value += [-1] * size
                after += range(len(check) + 1, len(check) + size + 1)
                check += [-1] * size
            if all(check[b + k] == -1 for k in kids):
                break
            i = free(i + 1)
        base[s] = b
        for k in kids:
            check[b + k] = s
        todo += [(b + k, node[k]) for k in kids]
    used = max(i for i, c in enumerate(check) if c != -1) + 1
    pad = len(letters) + 1  # so that any code stays inside
    as_array = lambda x, fill: np.concatenate((np.array(x[:used], np.int32), np.full(pad, fill, np.int32)))
    return codes, as_array(base, 0), as_array(check, -1), as_array(value, -1)


def prepare(path: str = MODEL) -> dict:
    """What tasks need, as plain values."""
    model = read_model(path)
    words = list(model["normal"])
    codes, base, check, value = build_trie(words)
    if any(MARKER in w.lstrip(MARKER) for w in words) or codes[ord("\n")]:
        raise ValueError("a piece goes on after a marker or a line end")
    codes[ord(" ")], codes[ord(MARKER)] = codes[ord(MARKER)], 0
    ids = np.array([model["normal"][w][0] for w in words], np.int32)
    scores = np.array([model["normal"][w][1] for w in words], np.float64)
    return {"codes": codes, "base": base, "check": check, "value": value, "ids": ids, "scores": scores, "byte_id": np.array(model["byte_id"], np.int32), "raw": model["raw"]}


class Encoder:
    def __init__(self, codes, base, check, value, ids, scores, byte_id, raw):
        self.codes, self.base, self.check, self.value, self.ids, self.scores, self.byte_id, self.raw = codes, base, check, value, ids, scores, byte_id, raw
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self):
        self.known.clear()
        self.pool, self.starts, self.sizes, self.used = array("i"), array("q"), array("i"), 0

    def best_paths(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """letters: code points, a row for each stretch, all of one length. For each end, the length and word (-1: unknown) of the best last piece."""
        n, size = letters.shape
        code = self.codes[letters]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        length, word = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        for i in range(size):
            rows, node = np.arange(n), np.zeros(n, np.int64)
            single = np.zeros(n, bool)
            for j in range(i, size):
                c = code[rows, j]
                to = self.base[node] + c
                ok = (self.check[to] == node) & (c > 0)
                rows, node = rows[ok], to[ok]
                if not len(rows):
                    break
                found = self.value[node]
                some = found >= 0
                at, got = rows[some], found[some]
                if j == i:
                    single[at] = True
                total = best[at, i] + self.scores[got]
                up = total > best[at, j + 1]
                at, got = at[up], got[up]
                best[at, j + 1], length[at, j + 1], word[at, j + 1] = total[up], j + 1 - i, got
            at = np.flatnonzero(~single)
            total = best[at, i] + self.unknown
            up = total > best[at, i + 1]
            at = at[up]
            best[at, i + 1], length[at, i + 1], word[at, i + 1] = total[up], 1, -1
        return length, word

    def _store(self, keys: list[str], letters: np.ndarray) -> None:
        length, word = self.best_paths(letters)
        for key, points, own, got in zip(keys, letters, length.tolist(), word.tolist()):
            at, path = len(own) - 1, []
            while at:
                if got[at] >= 0:
                    path.append(int(self.ids[got[at]]))
                else:
                    here = int(points[at - 1])
                    path += [int(self.byte_id[x]) for x in reversed(chr(here).encode("utf-8", "surrogatepass"))]
                at -= own[at]
            self.known[key] = len(self.starts)
            self.starts.append(self.used), self.sizes.append(len(path))
            self.used += len(path)
            self.pool.extend(path[::-1])

    def learn(self, keys: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for k in keys:
            by_size.setdefault(len(k), []).append(k)
        for size, some in by_size.items():
            step = 20_000 if size <= LOCKSTEP else 64
            for i in range(0, len(some), step):
                part = some[i : i + step]
                # A stretch that begins with a line end has no marker before it.
                marked = [k if k[:1] == "\n" else " " + k for k in part]
                for own in ([m for m in marked if m[0] == "\n"], [m for m in marked if m[0] != "\n"]):
                    if own:
                        letters = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), -1)
                        self._store([m if m[0] == "\n" else m[1:] for m in own], letters)

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Keys of the stretches: the marker before each is left out, but a stretch after a line end has none and keeps the line end."""
        if "  " in text or text[0] == " ":
            return [s if s[0] == "\n" else s[1:] for s in _STRETCH.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.forget()
        self.learn({k for p in parts for k in p}.difference(self.known))
        pool, starts, sizes = (np.array(x, t) for x, t in ((self.pool, np.int32), (self.starts, np.int64), (self.sizes, np.int64)))
        out, known = [], self.known
        for p in parts:
            at = np.fromiter(map(known.__getitem__, p), np.int64, len(p))
            n = sizes[at]
            ends = np.cumsum(n)
            out.append(pool[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(p) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, n_pieces, n_byte_pieces, ids (array<int>), ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(prepare(model))

    def make():
        coder = Encoder(**shared.value)
        is_byte = np.zeros(len(coder.raw), bool)
        is_byte[coder.byte_id] = True

        def run(rows):
            ids = coder.encode(rows["text"])
            return {
                "id": rows["id"], "n_pieces": [len(x) for x in ids], "n_byte_pieces": [int(is_byte[x].sum()) for x in ids], "ids": ids,
                "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], "round_trip": [coder.decode(x) == (t or "") for x, t in zip(ids, rows["text"])],
            }

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, n_pieces long, n_byte_pieces long, ids array<int>, ids_sha256 string, round_trip boolean", slice_bytes=SLICE)


def decoded(pieces: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id, text: the texts of arrays of ids (null: empty)."""
    shared = pieces.sparkSession.sparkContext.broadcast(prepare(model))

    def make():
        coder = Encoder(**shared.value)
        return lambda rows: {"id": rows["id"], "text": [coder.decode(np.array(x or [], np.int32)) for x in rows["ids"]]}

    return map_arrow(pieces.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), make, "id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
