"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Equal fingerprints are first reduced to one. Distinct fingerprints are put into tiles by their population count, tiles
of at most about TILE members by a hash split; only tiles whose counts differ by at most the radius meet. Inside a pair
of tiles the members are ordered by the population count of their upper half, and only stretches whose two half counts
can lie within the radius are compared, in blocks, with numpy. A pair of tiles gives the edges of a spanning forest of
its links, never all links, so a large group of near copies costs no more edges than members; components over all
edges follow in Spark. The comparison is exact and complete.

Its work grows with the square of the distinct fingerprints, divided by what the counts rule out; the memory of a task
is two tiles and a block.

Defined results: a null or empty text has fingerprint zero; null doc_ids are ignored in the smallest doc_id of a
component (null if there is no other); rows that repeat a doc_id keep a row each.
"""
from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, parts, table
from .graph import components

RADIUS = 4
WIDTH = 4
SEED = 42
TILE = 16_384
#: A tile's number is its population count times this, plus its place among the tiles of that count.
STRIDE = 1_000_000_000
#: Pairs that are compared at a time.
BLOCK = 1 << 17
#: Of 256 bits: those that may differ in a candidate. Fingerprints of shingle sets with a similarity (Jaccard) of 0.8
#: differ in about 39, in 48 at most (of five shingles four in common), with a deviation of 6.
WIDE_RADIUS = 72
#: And of the first 64 (12 at most, with a deviation of 3).
WIDE_FIRST = 22
#: Candidates are links if their sets of shingles have this similarity.
SIMILAR = 0.8
#: Members of a group of candidates that are compared with as many others in a task, at most about so many and of so many bytes of shingles.
CHUNK = 4096
CHUNK_BYTES = 4 << 20
#: Pairs whose parities of shingles are compared at a time.
PARITY_BLOCK = 1 << 13
#: Odd multipliers (fixed values).
_MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str | None, width: int = WIDTH, words: list[bytes] | None = None) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words than the width: of the whole sequence; none: nothing."""
    if words is None:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if n <= width:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1].tolist()
    return np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    return _majority(hashes.reshape(-1, 1))[0]


def _majority(hashes: np.ndarray) -> list[int]:
    """The fingerprint of each column. 255 rows at a time, which a byte can count."""
    if not len(hashes):
        return [0] * hashes.shape[1]
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 255):
        total += np.unpackbits(hashes[i : i + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8").tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, wide: bool = False) -> DataFrame:
    """id, fp (the fingerprint's bits as a long), more (wide: 192 bits more, of the hashes mixed anew), node (what tells fingerprints apart).

    wide: of the distinct shingles, so that the bits stand for the similarity of sets; node tells the sets apart."""

    def make():
        def run(rows):
            hashes = [np.unique(shingle_hashes(t, width)) if wide else shingle_hashes(t, width) for t in rows["text"]]
            found = [[_signed(x) for x in _majority(np.column_stack([h, *[_mixed(h, k) for k in _MIXERS]]) if wide else h.reshape(-1, 1))] for h in hashes]
            fps, more = [x[0] for x in found], [x[1:] for x in found]
            node = [_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in hashes] if wide else fps
            return {"id": rows["id"], "fp": fps, "more": more, "node": node}

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, fp long, more array<long>, node long")


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
        return (x ^ (x >> np.uint64(27))) * np.uint64(_MIXERS[0])


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = BLOCK, wide: tuple | None = None) -> list[tuple[int, int]]:
    """Edges (places in a and b) of a spanning forest of the links between a and b, or within a. a and b: uint64 values, all of one population count each.

    wide: (more bits of a, of b, radius of all bits), each a row of uint64 values: links must hold there, too."""
    half = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int64)
    own = b is None
    place_a = np.argsort(half(a), kind="stable")
    place_b = place_a if own else np.argsort(half(b), kind="stable")
    a, b = a[place_a], (a if own else b)[place_b]
    if wide:
        more_a, more_b = wide[0][place_a], (wide[0] if own else wide[1])[place_b]
    ha, hb = half(a), half(b)
    if not len(a) or not len(b):
        return []
    low = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0]))
    first_b = 0 if own else len(a)
    label = np.arange(first_b + len(b))  # the tree of each member
    edges = []
    levels = {int(h): np.searchsorted(hb, [h, h + 1]).tolist() for h in np.unique(hb)}
    for h in np.unique(ha).tolist():
        i0, i1 = np.searchsorted(ha, [h, h + 1]).tolist()
        for g, (j0, j1) in levels.items():
            if abs(g - h) + abs(low - (g - h)) > radius or own and g < h:
                continue
            step = max(1, block // (j1 - j0))
            for i in range(i0, i1, step):
                near = np.bitwise_count(a[i : min(i + step, i1), None] ^ b[None, j0:j1]) <= radius
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                x, y = x + i, y + j0
                if wide:
                    some = np.bitwise_count(a[x] ^ b[y]) + np.bitwise_count(more_a[x] ^ more_b[y]).sum(axis=1) <= wide[2]
                    x, y = x[some], y[some]
                p, q = label[x], label[y + first_b]
                if not len(new := np.flatnonzero(p != q)):
                    continue
                parent: dict[int, int] = {}

                def root(t: int) -> int:
                    while (up := parent.get(t, t)) != t:
                        parent[t] = t = parent.get(up, up)
                    return t

                for k, r, s in zip(new.tolist(), p[new].tolist(), q[new].tolist()):
                    if (r := root(r)) != (s := root(s)):
                        parent[max(r, s)] = min(r, s)
                        edges.append((int(place_a[x[k]]), int(place_b[y[k]])))
                move = np.arange(len(label))
                for t in list(parent):
                    move[t] = root(t)
                label = move[label]
    return edges


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, wide_radius: int | None = None) -> DataFrame:
    """distinct: fp, more, node (distinct, no null; a written table). a, b: edges that connect just the nodes that links within the radius connect."""
    spark = distinct.sparkSession
    counted = distinct.withColumn("p", F.bit_count("fp"))
    # 65 numbers at most: into how many tiles each population count is split.
    split = {r["p"]: -(-r["n"] // tile) for r in counted.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not split:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b"))
    chunks = F.create_map(*[F.lit(int(x)) for kv in split.items() for x in kv])
    # In order of node: a tile is made once for each side of the join, and its members must have the same places on both.
    members = F.sort_array(F.collect_list(F.struct("node", "fp", "more")))
    tiles = counted.withColumn("c", F.pmod(F.xxhash64("node"), chunks[F.col("p")]).cast("int")).groupBy("p", "c").agg(members.alias("m"))
    tiles = tiles.select((F.col("p").cast("long") * STRIDE + F.col("c")).alias("t"), "p", F.col("m.node").alias("nodes"), F.col("m.fp").alias("fps"), F.flatten("m.more").alias("more"))
    # The partners of a tile: itself and later tiles of its own and the next `radius` population counts.
    names = F.array(*[F.struct(F.lit(int(p)).alias("p"), F.sequence(F.lit(0), F.lit(int(n) - 1)).alias("cs")) for p, n in sorted(split.items())])
    near = F.flatten(F.transform(F.filter(names, lambda x: (x["p"] >= F.col("p")) & (x["p"] <= F.col("p") + radius)), lambda x: F.transform(x["cs"], lambda c: x["p"].cast("long") * STRIDE + c)))
    left = tiles.select(F.col("t").alias("s"), *[F.col(c).alias(f"l_{c}") for c in ("nodes", "fps", "more")], F.explode(F.filter(near, lambda x: x >= F.col("t"))).alias("t"))
    pairs = left.join(tiles.drop("p"), "t").repartition(4 * parts(spark), "s", "t")

    def make():
        def bits(x, n):
            return np.array(x, np.int64).view(np.uint64).reshape(n, -1)

        def run(rows):
            out = {"a": [], "b": []}
            for s, t, la, ra, fa, fb, ma, mb in zip(*[rows[c] for c in ("s", "t", "l_nodes", "nodes", "l_fps", "fps", "l_more", "more")]):
                wide = (bits(ma, len(la)), bits(mb, len(ra)), wide_radius) if wide_radius is not None else None
                edges = forest(bits(fa, len(fa)).ravel(), None if s == t else bits(fb, len(fb)).ravel(), radius, wide=wide)
                out["a"] += [la[i] for i, _ in edges]
                out["b"] += [ra[j] for _, j in edges]
            return out

        return run

    return map_arrow(pairs, make, "a long, b long")


def classes(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE, wide_radius: int | None = None) -> DataFrame:
    """prints: as fingerprints gives, a written table. node, component_id for every distinct fingerprint."""
    distinct = scratch.save(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("more").alias("more")), "distinct")
    roots = components(links(distinct.select("fp", "more", "node"), radius, tile, wide_radius), scratch).withColumnRenamed("node", "n")
    rooted = distinct.join(roots, distinct["node"] == roots["n"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("node", "component_id")


def similar_classes(prints: DataFrame, texts: DataFrame, scratch: Scratch, width: int, tile: int = TILE) -> DataFrame:
    """node, component_id: components over the pairs of texts whose sets of shingles have a similarity of SIMILAR or more.

    prints: as fingerprints gives with wide, a written table, whose rows may repeat. texts: id, text, a row for each id.

    Fingerprints give candidates, of which each link is tested on the shingles. A forest of the candidates is tested
    first. Where all of a group's edges hold, its members are one class; in the other groups the candidates between
    classes are tested, in chunks, so that no group is gathered. A pair of chunks gives a forest of links, so rows don't
    grow with the pairs of a group; the comparisons of bits in its tasks do."""
    distinct = scratch.save(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("more").alias("more")), "distinct")
    edges = scratch.save(links(distinct.select("fp", "more", "node"), WIDE_FIRST, tile, WIDE_RADIUS).where("a <> b").distinct(), "candidates")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(distinct.select("node", "least"), "node")
    shingles = scratch.save(_shingles(ends.join(texts, F.col("least") == F.col("id")).select("node", "text"), width), "shingles")
    held = scratch.save(_similar(edges, shingles), "held")
    groups = scratch.save(_rooted(components(edges, scratch), shingles), "groups")
    held_roots = scratch.save(_rooted(components(held, _within(scratch, "held")), distinct), "held-roots")
    # Groups with an edge that doesn't hold.
    open_groups = edges.join(held, ["a", "b"], "left_anti").join(groups, F.col("a") == groups["node"]).select("root").distinct()
    members = groups.join(open_groups, "root", "left_semi").join(held_roots.withColumnRenamed("root", "own"), "node").join(distinct.select("node", "fp", "more"), "node").join(shingles, "node")
    more = scratch.save(_links_between(scratch.save(members, "open")), "more")
    if more.isEmpty():
        rooted = held_roots
    else:
        rooted = scratch.save(_rooted(components(held.union(more), _within(scratch, "all")), distinct), "all-roots")
    rooted = distinct.select("node", "least").join(rooted, "node")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")


def _links_between(members: DataFrame) -> DataFrame:
    """a, b: links between classes of a group, which connect what all its links connect. members: root (the group), own (the class), node, fp, more, set; a written table."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.octet_length("set")) / CHUNK_BYTES))
    dealt = members.join(members.groupBy("root").agg(size.cast("int").alias("n")), "root").withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    columns = ("node", "own", "fp", "more", "set")
    # In order of node: a chunk is made once for each side of the join, and its members must have the same places on both.
    chunks = dealt.groupBy("root", "n", "c").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("m"))
    left = chunks.select("root", F.col("c").alias("i"), F.explode(F.sequence(F.col("c"), F.col("n") - 1)).alias("j"), *[(F.flatten(f"m.{c}") if c == "more" else F.col(f"m.{c}")).alias(f"l_{c}") for c in columns])
    right = chunks.select("root", F.col("c").alias("j"), *[(F.flatten(f"m.{c}") if c == "more" else F.col(f"m.{c}")).alias(f"r_{c}") for c in columns])
    pairs = left.join(right, ["root", "j"]).repartition(4 * parts(members.sparkSession), "root", "i", "j")

    def make():
        def side(rows, k, of):
            bits = [np.array(rows[f"{of}_{c}"][k], np.int64).view(np.uint64) for c in ("fp", "more")]
            return rows[f"{of}_own"][k], np.column_stack([bits[0], bits[1].reshape(len(bits[0]), -1)]), [np.frombuffer(x, np.uint64) for x in rows[f"{of}_set"][k]]

        def run(rows):
            out = {"a": [], "b": []}
            for k, (i, j, la, ra) in enumerate(zip(*[rows[c] for c in ("i", "j", "l_node", "r_node")])):
                edges = similar_forest(side(rows, k, "l"), None if i == j else side(rows, k, "r"))
                out["a"] += [la[x] for x, _ in edges]
                out["b"] += [ra[y] for _, y in edges]
            return out

        return run

    return map_arrow(pairs, make, "a long, b long")


def _parities(sets: list[np.ndarray], width: int, step: int = 256) -> np.ndarray:
    """A row of `width` bits for each set: whether it has an odd number of the hashes that fall on a bit. Two rows differ in no more bits than the sets in members."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    for i in range(0, len(sets), step):
        some = sets[i : i + step]
        at = np.repeat(np.arange(len(some)) * width, [len(x) for x in some]) + (np.concatenate(some) % np.uint64(width)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(some) * width) & 1).astype(bool)
        out[i : i + step] = np.packbits(odd.reshape(len(some), width), axis=1).view(np.uint64)
    return out


def similar_forest(left: tuple, right: tuple | None, block: int = BLOCK) -> list[tuple[int, int]]:
    """Edges (places in left and right, or within left) of links between classes: with the classes, a spanning forest of all links.

    left, right: classes, rows of the fingerprints' bits, sets of shingles (ascending). A pair in one class by then isn't
    looked at; one whose parities differ in more bits than sets of SIMILAR may is none; the others are tested on the sets."""
    own = right is None
    (own_a, bits_a, sets_a), (own_b, bits_b, sets_b) = left, left if own else right
    names, label = np.unique(np.array([*own_a, *own_b], np.int64), return_inverse=True)
    if len(names) < 2:
        return []
    tree = np.arange(len(names))
    la, lb = label[: len(own_a)], label[len(own_a) :]
    longest = max(map(len, [*sets_a, *sets_b]))
    width = min(1 << 13, 1 << max(10, (2 * longest).bit_length()))
    par_a = _parities(sets_a, width)
    par_b = par_a if own else _parities(sets_b, width)
    len_a, len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (sets_a, sets_b))
    differ = (1 - SIMILAR) / (1 + SIMILAR)  # of the members of both sets
    edges = []

    def root(t: int) -> int:
        while tree[t] != t:
            tree[t] = t = tree[tree[t]]
        return int(t)

    step = max(1, block // len(lb))
    for i in range(0, len(la), step):
        first = i + 1 if own else 0
        near = np.bitwise_count(bits_a[i : i + step, None, 0] ^ bits_b[None, first:, 0]) <= WIDE_FIRST
        x, y = np.nonzero(near)
        x, y = x + i, y + first
        some = (tree[la[x]] != tree[lb[y]]) & ((x < y) | (not own))
        x, y = x[some], y[some]
        some = np.bitwise_count(bits_a[x] ^ bits_b[y]).sum(axis=1) <= WIDE_RADIUS
        x, y = x[some], y[some]
        for k in range(0, len(x), PARITY_BLOCK):
            p, q = x[k : k + PARITY_BLOCK], y[k : k + PARITY_BLOCK]
            some = np.bitwise_count(par_a[p] ^ par_b[q]).sum(axis=1, dtype=np.int64) <= differ * (len_a[p] + len_b[q]) + 1e-6
            for u, v in zip(p[some].tolist(), q[some].tolist()):
                r, s = root(la[u]), root(lb[v])
                if r != s and jaccard(sets_a[u], sets_b[v]) >= SIMILAR:
                    tree[max(r, s)] = min(r, s)
                    edges.append((u, v))
        tree = np.array([root(t) for t in range(len(tree))]) if edges else tree
    return edges


def _within(scratch: Scratch, job: str) -> Scratch:
    return Scratch(scratch.spark, f"simhash-{job}")


def _rooted(roots: DataFrame, distinct: DataFrame) -> DataFrame:
    """node, root of every node: its own if it has no edge or is the root, which components doesn't list."""
    return distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """node, set (the distinct hashes, ascending, eight bytes each)."""

    def make():
        def run(rows):
            return {"node": rows["node"], "set": [np.unique(shingle_hashes(t, width)).tobytes() for t in rows["text"]]}

        return run

    return map_arrow(texts, make, "node long, set binary")


def _similar(edges: DataFrame, shingles: DataFrame) -> DataFrame:
    """a, b: of the edges those whose ends are similar."""
    both = edges.join(shingles.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(shingles.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def make():
        def run(rows):
            keep = [k for k, (x, y) in enumerate(zip(rows["x"], rows["y"])) if jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILAR]
            return {c: [rows[c][k] for k in keep] for c in ("a", "b")}

        return run

    return map_arrow(both.select("a", "b", "x", "y"), make, "a long, b long")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of sets, ascending."""
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return 0.0  # below SIMILAR
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """id, fp, node, component_id: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, width), "prints")
    return prints.join(classes(prints, scratch, radius, tile), "node")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
