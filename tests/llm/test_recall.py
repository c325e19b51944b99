"""Recall of the training-data operators against brute force."""
import random

import pytest

from ringproof.llm import decontaminate, pii, simhash


def test_large_benchmark_loses_no_copy(spark):
    """Over 1,024 items of one vocabulary; copies with an edit in every sixth word, anywhere in a text."""
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(700)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: text(r.randint(12, 60)) for i in range(1100)}
    docs = {i: text(r.randint(0, 60)) + [w if i % 2 or k % 6 < 5 else "new" for k, w in enumerate(items[i * 9])] + text(r.randint(0, 60)) for i in range(120)}
    want = {(d, i) for d, ws in docs.items() for i, item in items.items() if decontaminate.lcs(item, ws) >= 0.8 * len(item)}
    assert want >= {(d, d * 9) for d in docs}
    join = lambda rows, *names: spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows.items()], f"{names[0]} long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(join(docs, "doc_id"), join(items, "item_id")).collect()}
    assert got == want


def test_item_in_most_documents_is_found(spark):
    """Half the documents hold the item, so that each of its words is frequent; one holds it as a paraphrase without a run of three words."""
    r = random.Random(6)
    item = " ".join(f"q{k}" for k in range(30))
    other = lambda n: " ".join(f"v{r.randrange(900)}" for _ in range(n))
    docs = [(i, f"{other(40)} {item} {other(40)}" if i % 2 else other(80)) for i in range(60)]
    docs.append((60, " ".join(f"q{k} q{k + 1} q{k}" for k in range(0, 30, 2))))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {x.doc_id for x in found.collect()} == {i for i in range(60) if i % 2} | {60}
    weight = decontaminate.word_weights(decontaminate.hashed(spark.createDataFrame([(1, item)] * 3, "id long, text string")))
    assert (weight > 0).all()


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
        ("write to ann@site(.)org today", "email", "ann@site(.)org"),
        ("write to ann @site.org today", "email", "ann @site.org"),
        ("write to ann@ site.org today", "email", "ann@ site.org"),
        ("write to ann\n@\nsite.org today", "email", "ann\n@\nsite.org"),
        ("one·two·three·four·five·six·seven·eight·nine·zero", "phone", "one·two·three·four·five·six·seven·eight·nine·zero"),
        ("triple one triple two triple three one", "phone", "triple one triple two triple three one"),
        ("triple three triple five quatuple, double six triple five triple one double six", "phone", "double six triple five triple one double six"),
        ("mail j\u043ehn@example.com now", "email", "j\u043ehn@example.com"),
        ("mail john dot smith@example.com now", "email", "john dot smith@example.com"),
    ],
)
def test_disguise_alone_in_a_text(text, kind, part):
    base, added = pii.spans(text)
    assert (kind, part) in [(k, text[a:b]) for k, a, b in added]
    assert base == pii.find(text)


def test_plain_address_is_no_disguise():
    assert pii.spans("mail john@example.com at noon. One two three and the rest (done).")[1] == []


def test_near_duplicates_against_brute_force(spark):
    """Variants with similarities from 0.7 to 0.9, and a text with one shingle many times."""
    import corpus_pipeline

    r = random.Random(7)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    docs = []
    for n in [12, 24, 48, 90] * 8:
        base = text(n)
        docs.append(base)
        for share in (0.9, 0.86, 0.82, 0.8, 0.78, 0.74, 0.7):
            # A changed tail of k words: m - k shingles of m + k are common.
            k = round((n - 4) * (1 - share) / (1 + share))
            docs.append(base[: n - k] + text(k))
    docs += [["word"] * 300 + text(20), ["word"] * 300]
    sets = [{tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in docs]
    root = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if p in (a, b) else p for p in root]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(docs)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in out.collect()} == set(root)


def test_null_and_repeated_ids_are_judged_by_text(spark):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    a, b, c, item = text(40), text(40), text(40), text(30)
    rows = [(None, a), (None, a), (None, b), (3, b), (4, b), (7, a + " tail"), (9, text(40)), (9, c), (9, c), (None, ""), (11, " "), (11, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(7, a + " tail"), (3, b), rows[6], (9, c), *rows[9:]], key=str)
    leaky = spark.createDataFrame([(None, f"{a} {item}"), (None, a), (5, f"{b} {item}"), (5, c)], "doc_id long, text string")
    clean = corpus_pipeline.decontaminate.apply(corpus_pipeline._keyed(leaky), spark.createDataFrame([(1, item)], "item_id long, text string"), corpus_pipeline.KEY)
    assert {(x.doc_id, x.text) for x in clean.collect()} == {(None, a), (5, c)}


def test_near_duplicates_within_a_group_of_candidates(spark, monkeypatch):
    """Copies of a page with more or fewer changes, most of them candidates of each other: few links hold, and the links written between classes don't grow with the pairs."""
    import corpus_pipeline

    r = random.Random(11)
    page = [f"w{r.randrange(5000)}" for _ in range(80)]
    docs = [list(page) for _ in range(240)]
    for i, ws in enumerate(docs):
        for _ in range(1 + i % 4):
            ws[r.randrange(80)] = f"x{i}y{r.randrange(5000)}"
    pages = [[f"v{r.randrange(5000)}" for _ in range(60)] for _ in range(30)]
    for ws in pages:
        docs += [ws[:k] + [f"z{r.randrange(10**6)}" for _ in range(60 - k)] for k in (60, 56, 52, 48)]
    sets = [{tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in docs]
    root = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if p in (a, b) else p for p in root]
    saved, save = {}, simhash.Scratch.save

    def recorded(self, df, name, *args):
        saved[name] = save(self, df, name, *args)
        return saved[name]

    monkeypatch.setattr(simhash.Scratch, "save", recorded)
    rows = [(i, " ".join(ws)) for i, ws in enumerate(docs)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in out.collect()} == set(root)
    assert 0 < saved["more"].count() < len(docs)  # a single chunk: fewer than its members
    monkeypatch.setattr(simhash, "CHUNK", 50)
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in out.collect()} == set(root)
