"""The training-data operators on a small table with nulls, empty and repeated rows, against plain versions."""
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringproof.llm import decontaminate, language_model, line_dedup, passages, pieces, pii, quality_classifier, quality_rules, simhash, warc
from ringproof.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id string"


def rows():
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["The", "of", "and"] * 20
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, out = text(70), []
    for i in range(40):
        t = text(r.randint(5, 120)) + (f" {shared} " if i % 3 == 0 else "") + "\nCommon line\n" * (i % 2)
        out.append((i, t))
    out += [(40, out[3][1]), (41, out[3][1] + " tail"), (42, ""), (43, None), (44, "   \n\t"), (45, "x"), (5, out[5][1]), (None, "Common line\nown"), (46, "word " * 3000)]
    return [(i, t, None if (i or 0) % 7 == 0 else "en", "src0" if (i or 0) % 3 else None, None, "clash", "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


def test_empty_tables(none, spark):
    assert quality_rules.judged(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert pii.detect(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert line_dedup.apply(none).count() == 0
    assert pieces.encoded(none).count() == 0
    assert language_model.scored(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality_classifier.classified(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.col("source"), F.col("source"), keep=["doc_id"]).count() == 0


def test_quality_rules(docs):
    got = Counter((r.id, r.n_words) for r in quality_rules.judged(docs).collect())
    assert got == Counter((i, len(words_of(t))) for i, t, *_ in rows())
    assert quality_rules.measure("a b c a b c x") == (7, 7, 0, 0, 6, 1, 0)


def test_simhash(docs):
    fps = [simhash.fingerprint(simhash.shingle_hashes(t)) for _, t, *_ in rows()]
    ids = [i for i, *_ in rows()]
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    least = {p: min((x for x, q in zip(ids, parent) if q == p and x is not None), default=None) for p in parent}
    want = Counter((i, simhash._signed(f), least[p]) for i, f, p in zip(ids, fps, parent))
    assert Counter((r.id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


def test_passages(docs):
    data = [(i, words_of(t)) for i, t, *_ in rows()]
    first = {}
    for i, ws in data:
        for k in range(len(ws) - 49):
            key = tuple(ws[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, ws in data:
        gone = {p for k in range(len(ws) - 49) if i is not None and first[tuple(ws[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        want[(i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_passages(docs).collect()) == want


def test_line_dedup(docs):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    n = Counter()
    for i, lines in {(i, k) for i, t, *_ in rows() for k in map(key, (t or "").split("\n"))}:
        n[lines] += 1
    got = line_dedup.dedup_lines(docs).select("doc_id", F.array_join("_rp_kept", "\n").alias("t")).collect()
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if not (key(x) and n[key(x)] >= 10))) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.t) for r in got) == want


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "é" * 9)]
    scratch = Scratch(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch)
    got = {r.page_id: r for r in warc.rebuild(*warc.read_archive(scratch)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None)}
    assert all(bytes(got[i].payload) == (h or "").encode() for i, _, h in pages)
    for i, _, h in pages:
        head, _, rest = bytes(got[i].record).partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith(b"" if got[i].record_type == "revisit" else (h or "").encode())


def test_pii():
    t = "mail jоe@exаmple.com, ann [at] site [dot] org, plus one five five five one two three four five six seven, a@b.cd 10.0.0.1 300.1.1.1, 4532015112830366"
    base, added = pii.spans(t)
    assert [(k, t[a:b]) for k, a, b in base] == [("email", "a@b.cd"), ("ip", "10.0.0.1"), ("card", "4532015112830366")]
    assert [(k, t[a:b]) for k, a, b in added] == [("email", "jоe@exаmple.com"), ("email", "ann [at] site [dot] org"), ("phone", "plus one five five five one two three four five six seven")]
    assert pii.spans("one one one one one one one one one one looked at the dot com")[1] == []
    assert pii.spans(None) == ([], []) and pii.find("9" * 5000 + ".1.1.1") == []


def test_pieces_best_score():
    sentencepiece = pytest.importorskip("sentencepiece")
    coder = pieces.Encoder(**pieces.prepare())
    model = pieces.read_model()
    score = {i: s for i, s in model["normal"].values()}
    del sentencepiece
    r = random.Random(1)
    letters = ["a", "the", " ", "  ", "\n", "é", "ing", "▁", "😀", "t", "he"]

    def best(s):  # plain search over all cuts
        table = [(0.0, 0)] + [(-1e30, 0)] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 16), e):
                own = model["normal"].get(s[b:e])
                v = own[1] if own else coder.unknown if e - b == 1 else None
                if v is not None and table[b][0] + v > table[e][0]:
                    table[e] = (table[b][0] + v, b)
        return table[-1][0]

    for _ in range(300):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        ids = coder.encode([t])[0]
        assert coder.decode(ids) == t
        if t and "▁" not in t and t.isascii() and "\n" not in t:
            assert abs(sum(score[i] for i in ids.tolist()) - best("▁" + t.replace(" ", "▁"))) < 1e-6


def test_language_model_base(docs):
    data = [(i, [w.lower() for w in words_of(t)] + ["\n"]) for i, t, *_ in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    n = Counter(w for i, ws in data if not held(i) for w in ws)
    import math

    total = sum(n.values())
    norm = math.log10(total + 0.1 * (len(n) + 1))
    want = sorted((str(i), held(i), len(ws), sum(n[w] > 0 for w in ws), total, round(sum(math.log10(n[w] + 0.1) - norm for w in ws), 6)) for i, ws in data)
    got = language_model.scored(docs).collect()
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    base = [(i, " ".join(f"v{(i * 37 + k) % 997}" for k in range(200))) for i in range(40)]
    hit = (40, base[0][1] + " " + item.upper().replace(" ", ", ") + " " + base[1][1])
    near = (41, base[2][1] + " " + item.replace("gamma ", "gamma extra ") + " " + base[3][1])
    got = decontaminate.contaminated(spark.createDataFrame([*base, hit, near, (42, None)], "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(40, 7), (41, 7)}


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_classifier.classified(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0"), *quality_classifier.document_sites(), keep=["doc_id"])
    got = found.join(labels.where("doc_id % 2 = 1"), "doc_id").select("accepted", labels["quality"], labels["toxic"]).collect()
    clean = [r.accepted for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.9 * len(clean)


def test_pipeline_stages(docs, spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5
    out = p.drop_near_duplicates(spark, docs, "")
    kept = [r.doc_id for r in out.collect()]
    assert 40 not in kept and 41 not in kept and 3 in kept and {42, 43, 44, None} <= set(kept) and kept.count(5) == 1
