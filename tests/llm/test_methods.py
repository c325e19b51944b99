"""The methods behind the operators, against plain versions on small inputs."""
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ringproof.llm import passages, pii, quality_classifier, quality_rules, warc
from ringproof.llm.common import Scratch, join_hot


def plain_base(text):
    """The base spans, by the patterns as they are stated."""
    out = []
    luhn = lambda ds: sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(ds))) % 10 == 0
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        ds = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(ds) <= 19 and luhn(ds):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_against_the_stated_patterns():
    r = random.Random(4)
    for alphabet in ("a1._%+-@ ", "12.5 +(-", "0123456789 -+", "ab.@é9_"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.find(t) == plain_base(t), t
            assert pii.spans(t)[0] == plain_base(t)


def test_pii_long_runs_take_linear_time():
    began = time.time()
    for t in ("9" * 100_000, "a" * 100_000 + " x@y", "1." * 50_000, "a." * 50_000 + "@", "dot " * 20_000 + "[at]" + "b" * 60_000):
        pii.spans(t)
    assert time.time() - began < 30


def test_pii_long_white_space_and_runs_of_words():
    n = 1_000_000
    for t in ("mail dot com a" + " " * n + "b", "mail dot com a" + "\n" * n + "b", "one" + " " * n + "two three four", "double" + "\t " * (n // 2) + "(dot)", "a dot " * (n // 6), "x at " + "b dot " * (n // 6) + "c", "1 dot " * (n // 6)):
        began = time.time()
        pii.spans(t)
        assert time.time() - began < 20, t[:20]


def test_pii_disguises_of_any_length():
    local, host = " dot ".join(f"w{i}" for i in range(30)), " dot ".join(f"h{i}" for i in range(40))
    for t in (f"{local} at {host}", f"{local} (at) {host}", f"a dot  b{' ' * 5000}at\n\n\n\nc [dot]{' ' * 5000}com"):
        assert pii.spans(f"«{t}»")[1] == [("email", 1, 1 + len(t))]
    assert pii.spans("polka dot at example dot com")[1] == [("email", 6, 28)]  # no part "at"
    # Long blanks are no disguise, and join nothing that two do not join.
    assert pii.spans("4111   1111   1111   1111 (at) +49   170 1234567 x")[1] == [] and pii.spans("+49   170   1234567")[0] == [("phone", 0, 19)]


def test_pii_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, None), (2, "")], "doc_id long, text string").withColumn("id", F.lit("clash"))
    assert Counter((r.id, len(r.base)) for r in pii.detect(docs).collect()) == Counter({(1, 1): 2, (None, 0): 1, (2, 0): 1})


def test_shrinkage_on_sparse_sites(spark):
    """Many sites of one to three documents, and one of very many, against plain sums."""
    r = random.Random(5)
    rows = []
    for k in range(300):
        lean = r.random()
        for i in range(400 if k == 0 else r.randint(1, 3)):
            rows.append((f"h{k}", f"h{k}/{i % 3}", min(0.99, max(0.01, r.gauss(lean, 0.2)))))
    rows += [("", "", 0.5), ("", "", 0.5)]
    df = spark.createDataFrame(rows, "_host string, _path string, quality double")
    sites = quality_classifier.site_posteriors(df.withColumnsRenamed({"_host": "host", "_path": "path"}), "quality").withColumnsRenamed({"host": "_host", "path": "_path"})
    got = Counter((x._host, x._path, round(x.quality, 9), round(x.quality_posterior, 6)) for x in quality_classifier.with_posterior(df, sites, "quality").collect())
    from math import exp, log

    host, path = defaultdict(list), defaultdict(list)
    for h, p, q in rows:
        host[h].append(q)
        path[p].append(q)
    every = [q for _, _, q in rows]
    n, mean = len(every), sum(every) / len(every)
    squares = sum(q * q for q in every)
    between = {"host": sum(sum(v) ** 2 / len(v) for v in host.values()), "path": sum(sum(v) ** 2 / len(v) for v in path.values())}

    def strength(b, within, groups):
        v_in = within / max(n - groups, 1)
        v_out = (b / max(groups - 1, 1) - v_in) / max(n / groups, 1)
        return min(max(v_in / max(v_out, 1e-6), 5), 100_000)

    k_host = strength(between["host"] - n * mean * mean, squares - between["host"], len(host))
    k_path = strength(between["path"] - between["host"], squares - between["path"], len(path))
    logit = lambda x: log(x / (1 - x))
    want: Counter = Counter()
    for h, p, q in rows:
        a = (k_host * mean + sum(host[h]) - q) / (k_host + len(host[h]) - 1)
        b = (k_path * a + sum(path[p]) - q) / (k_path + len(path[p]) - 1)
        want[h, p, round(q, 9), round(1 / (1 + exp(-(logit(q) + logit(min(max(b, 1e-6), 1 - 1e-6)) - logit(mean)))), 6)] += 1
    assert got == want
    # A site of one document has nothing but its prior: its posterior stays close to the document's own evidence.
    assert k_host >= 5 and k_path >= 5


def test_classifier_errs_little_on_either_side(spark):
    """Held-out labels: good documents stay, poor and toxic ones go; nulls, repeats and clashing names pass through."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("_host", F.lit("clash"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, "x"), (0, "", None, None, "x"), (0, "", None, None, "x")], docs.schema))
    found = quality_classifier.classified(docs, labels.where("doc_id % 2 = 0"), *quality_classifier.document_sites(), keep=["doc_id"]).cache()
    assert found.count() == docs.count()
    got = found.join(labels.where("doc_id % 2 = 1"), "doc_id").select("accepted", labels["quality"], labels["toxic"]).collect()
    share = lambda xs: sum(xs) / len(xs)
    assert share([r.accepted for r in got if r.quality == 1 and r.toxic == 0]) >= 0.95
    assert share([r.accepted for r in got if r.quality == 0 and r.toxic == 0]) <= 0.1
    assert share([r.accepted for r in got if r.toxic == 1]) <= 0.4


def test_page_sites(spark):
    url = spark.createDataFrame([("http://u@A.com:80/x/y?z",), ("ftp://b",), (None,)], "url string")
    assert [tuple(r) for r in url.select(*quality_classifier.page_sites(F.col("url"))).collect()] == [("a.com", "a.com/x"), ("b", "b/"), (None, "")]


def test_an_emptied_automaton_finds_nothing(spark, monkeypatch):
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    shared = words(80)
    docs = spark.createDataFrame([(i, f"{words(30)} {shared} {words(30)}") for i in range(6)], "doc_id long, text string")
    removed = lambda: {x.id: x.n_removed for x in passages.repeated_passages(docs).collect()}
    assert removed() == {i: 80 if i else 0 for i in range(6)}
    monkeypatch.setattr(passages, "symbols", lambda x: "\U000fffff" * len(x))
    assert set(removed().values()) == {80, 0}  # one pattern that fits everywhere finds all places, too
    monkeypatch.setattr(passages.Reader, "located", lambda self, docs, patterns, real=passages.Reader.located: real(self, docs, [[] for _ in patterns]))
    assert set(removed().values()) == {0}


def test_hot_keys_are_joined_apart(spark):
    r = random.Random(7)
    left = [(("hot", "warm", f"k{r.randrange(3000)}")[min(2, int(r.paretovariate(0.7)) - 1)], i) for i in range(5000)] + [(None, -1)]
    n = Counter(k for k, _ in left if k)
    right = [(k, k.upper(), c) for k, c in n.items() if k != "k5"]
    l, s = spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, v string, _n long")
    got = lambda how: sorted((x.i, x.v) for x in join_hot(l, s, "k", how).collect())
    want = {k: v for k, v, _ in right}
    assert got("left") == sorted((i, want.get(k)) for k, i in left) or got("left") == sorted(((i, want.get(k)) for k, i in left), key=str)
    assert got("inner") == sorted((i, want[k]) for k, i in left if k in want)


def test_fences_against_plain_quantiles(spark):
    r = random.Random(8)
    rows = [(lang, f"s{r.randrange(3)}", *[r.choice([0, 0, r.randrange(900_000)]) for _ in range(3)], r.randrange(1, 60_000), r.randrange(3000, 9000)) for lang in ("en", "de", "") for _ in range(400 if lang == "en" else 30)]
    names = list(quality_rules.FEATURES)
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} long" for f in names))
    got = {(x.lang, x.source): {s: x[s] for s in quality_rules.SIDES} for x in quality_rules.thresholds(quality_rules.sketch(df)).collect()}
    cut = lambda v: v >> max(v.bit_length() - quality_rules.BITS, 0) << max(v.bit_length() - quality_rules.BITS, 0)
    at = lambda vs, p: next(v for i, v in enumerate(sorted(vs), 1) if i * 100 >= len(vs) * p)

    def fence(part, side):
        f, _, end = side.rpartition("_")
        vs = [cut(x[2 + names.index(f)]) for x in part]
        q10, q50, q90, top = (at(vs, p) for p in (10, 50, 90, quality_rules.TOP))
        if quality_rules.FEATURES[f][0]:
            return q50 - 3 * (q50 - q10) if end == "low" else q50 + 3 * (q90 - q50)
        return max(top, at([v for v in vs if v], 50) if any(vs) else 0)

    mix = lambda n, own, wide: int((n * own + quality_rules.PRIOR * wide) / (n + quality_rules.PRIOR))
    for (lang, source), found in got.items():
        own, wide = [x for x in rows if x[:2] == (lang, source)], [x for x in rows if x[0] == lang]
        assert found == {s: mix(len(own), fence(own, s), mix(len(wide), fence(wide, s), fence(rows, s))) for s in quality_rules.SIDES}
    assert len({x["symbols_ppm_high"] for x in got.values()}) > 1


def test_archive_of_nothing_and_of_repeated_pages(spark):
    schema = "page_id long, url string, html string, digest string"
    for rows in ([], [(1, "u", "x", "clash"), (1, "u", "x", "clash"), (2, "u", "x", "clash"), (None, None, "x", None), (None, "v", "", None)]):
        scratch = Scratch(spark, "test-warc")
        warc.write_archive(spark.createDataFrame(rows, schema), scratch)
        records, payloads = warc.read_archive(scratch)
        got = warc.rebuild(records, payloads).collect()
        assert len(got) == len(rows) and len({re.search(rb"WARC-Record-ID: (\S+)", bytes(x.record))[1] for x in got}) == len(rows)
        assert warc.proven(warc.rebuild(records.where("record_type = 'response'"), payloads)).count() == sum(x.record_type == "response" for x in got)
    assert Counter((x.page_id, x.record_type, x.refers_to) for x in got) == Counter({(1, "response", None): 2, (2, "revisit", 1): 1, (None, "revisit", 1): 1, (None, "response", None): 1})


def test_a_damaged_payload_makes_the_read_fail(spark):
    scratch = Scratch(spark, "test-warc-damage")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), scratch)
    records, payloads = warc.read_archive(scratch)
    with pytest.raises(Exception, match="not as long"):
        warc.proven(warc.rebuild(records, payloads.withColumn("payload", F.encode(F.lit("xy"), "UTF-8")))).collect()
