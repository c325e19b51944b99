"""Source divergence, centroid clusters and mixing against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ringproof.llm import clusters, divergence, mixing
from ringproof.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least, top):
    """The stated contract, with whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    in_docs: Counter = Counter()
    for lang, _, terms in docs:
        in_docs.update({(lang, t) for t in terms})
    kept = defaultdict(set)
    for (lang, t), n in in_docs.items():
        if n >= least:
            kept[lang].add(t)
    count = defaultdict(Counter)
    for lang, source, terms in docs:
        own = Counter(t for t in terms if t in kept[lang])
        count[lang, source] += own
        count[lang, None] += own
    p = {key: (lambda t, c=c, n=sum(c.values()), v=len(kept[key[0]]): 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v)) for key, c in count.items()}
    out = []
    for lang, source in count:
        if source is None:
            continue
        part = {"pair": {o: sum(abs(p[lang, source](t) - p[lang, o](t)) for t in kept[lang]) for one, o in count if one == lang and o is not None and o != source}}
        part["term"] = {t: p[lang, source](t) - p[lang, None](t) for t in count[lang, source] if p[lang, source](t) > p[lang, None](t)}
        for name, values in part.items():
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, name, item, value, i + 1) for i, (item, value) in enumerate(ranked[: top if name == "term" else None])]
    return Counter(out)


def texts(r, n):
    long = "long" * 30
    words = ["The", "the", "tHEre", "a", "ab", "abc", "Äpfel", "äpfel", "naïve", "naive", "日本", "日本語", "x" * 40, long, long + "er", "it's", "n0t", "İstanbul", "é"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    return [" ".join(r.choice(words) + r.choice(["", ".", "-1", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_divergence_against_a_plain_version(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i if i % 7 else None, t, r.choice(["en", "de", "", None]), r.choice(["a", "b", "B", "ä", "", None, "hot", "hot", "hot"])) for i, t in enumerate(texts(r, 400))]
    rows += [(1, None, "en", "c"), (1, "", "xx", "d"), (1, "", "xx", "e"), (2, "rare", "yy", "e")] + [rows[5]] * 9
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("clash"), "prefix": F.lit(1), "i": F.lit(2), "counts": F.lit(3)})
    want = plain_audit(rows, 30, 50)
    read = lambda **o: Counter(map(tuple, divergence.audit(docs, **o).collect()))
    assert read() == want
    assert read(most=0) == want  # the ways beyond the bound of a broadcast
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SLICE", 5)
    assert read() == want
    assert read(min_docs=3, top=4) == plain_audit(rows, 3, 4)


def test_divergence_levels_only_follow_survivors(spark):
    """A discarded prefix isn't extended: below it no prefix is counted."""
    rows = [(i, "commonplace word" if i < 40 else f"lonelyhearted{'abcdefghij'[i % 10]}", "en", "s") for i in range(50)]
    scratch = Scratch(spark, "levels")
    terms = scratch.save(divergence.document_terms(spark.createDataFrame(rows, DOCS)), "documents")
    assert {r.term for r in divergence.kept_terms(terms, scratch).collect()} == {"commonplace\0", "word\0"}
    first = scratch.load("level-0").selectExpr("lang as _lang", "prefix as _prefix")
    assert {r._prefix for r in first.collect()} == {"common", "word\0"}
    second = divergence.prefix_counts(terms, 10, 6, first, 1 << 20).collect()
    assert {r.prefix for r in second} == {"commonplac"}


def test_divergence_counts_the_terms_of_a_slice_once(spark):
    """A row for each term, not for each document: documents where a prefix is new, level by level, and occurrences by source."""
    docs = spark.createDataFrame([(i, "alphabetical beta Alpha alphabet beta", "en", "ab"[i % 2]) for i in range(1000)], DOCS).coalesce(1)
    found = {r.term: (r.fresh, sorted(map(tuple, r.uses))) for r in divergence.document_terms(docs).collect()}
    one = [("a", 500), ("b", 500)]
    assert found == {"alpha\0": ([1000], one), "alphabet\0": ([1000, 1000], one), "alphabetical\0": ([0, 1000, 1000], one), "beta\0": ([1000], [("a", 1000), ("b", 1000)])}


def test_divergence_of_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in kept[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        centroids = [[sum(x) // len(of[i]) for x in zip(*of[i])] if i in of else c for i, c in enumerate(centroids)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in placed)


VECTORS = "vec_id long, embedding array<float>"


def test_clusters_against_a_plain_version(spark):
    r = random.Random(2)
    as_float = lambda v: [None if x is None else float(__import__("numpy").float32(x)) for x in v]
    rows = [(i, as_float([r.gauss(i % 5, 1) / 8 for _ in range(64)])) for i in range(300)]
    rows += [rows[3]] * 40 + [(None, as_float([0.25] * 64)), (7, as_float([-0.0] * 64)), (7, as_float([1e6] * 64))]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] + [0.5] * 63), (906, [float("-inf")] + [0.5] * 63)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({"v": F.lit(1), "cluster": F.lit("clash"), "x": F.lit(2)})
    assert Counter(map(tuple, clusters.cluster(df).drop("centroid").collect())) == plain_clusters(rows)


def test_clusters_of_few_and_of_equal_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(20)]  # all but the first centroid are empty, and stay
    assert Counter(map(tuple, clusters.cluster(spark.createDataFrame(same, VECTORS)).drop("centroid").collect())) == plain_clusters(same)
    few = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert Counter(map(tuple, clusters.cluster(spark.createDataFrame(few, VECTORS)).drop("centroid").collect())) == plain_clusters(few)
    assert clusters.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    huge = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]  # capped, not overflowing
    assert {r.vec_id for r in clusters.cluster(spark.createDataFrame(huge, VECTORS)).collect()} == {1, 2, 3}


def plain_targets(sizes):
    """By rounds, as stated: shares by weight, those above three times the size stop, the excess is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        above = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {s: float(x) for s, x in (share | stopped).items()}
        stopped |= above


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_plain_targets(spark, seed):
    r = random.Random(seed)
    source = lambda: None if r.random() < 0.1 else "hot" if r.random() < 0.4 else r.choice(["a", "é", "z", "Z", "", "s1", "s2"])
    rows = [(r.randint(0, 500) if r.random() < 0.8 else None, " ".join(["w"] * min(400, int(r.paretovariate(0.8)))), source()) for _ in range(1500)]
    rows += [(9, None, "a"), (9, "", "nothing"), (10, " \t\n", "nothing")] + [(11, "same words here", "copies")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "range": F.lit(1), "upto": F.lit(2), "n": F.lit(3)})
    got = mixing.mix(docs)
    sizes, words, taken = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    found = got.collect()
    assert Counter((x.doc_id, x["size"]) for x in found) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert Counter((x.source_size, x.target) for x in found) == Counter((sizes[s], want[s]) for _, _, s in rows)
    assert all(0 <= x.taken <= 3 * x["size"] and (not x["size"] or x.taken % x["size"] == 0) for x in found)
    most = max(x["size"] for x in found)
    for x in found:
        taken[x.target] += x.taken
    of_target = Counter(want.values())
    assert all(abs(taken[t] - t * of_target[t]) <= 2 * most * of_target[t] for t in taken)
    assert sum(sizes.values()) - most < sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs.repartition(7))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))
    assert words == Counter()


def test_mix_without_words_or_documents(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    assert [(x["size"], x.source_size, x.target, x.taken) for x in mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], kind)).collect()] == [(0, 0, 0.0, 0)] * 2
    alone = mixing.mix(spark.createDataFrame([(1, "a b c", None)], kind)).collect()
    assert [(x.target, x.taken) for x in alone] == [(3.0, 3)]


def test_mix_deals_many_equal_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "s")] * 100 + [(2, "c", "t")] * 30, "doc_id long, text string, source string")
    whole = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 7)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == whole
    assert sum(n for row, n in whole.items()) == 130
