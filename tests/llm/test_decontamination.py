"""Decontamination against all windows by all items, and recall on paraphrases."""
import random
import re
from collections import Counter
from math import log, sqrt

import pytest

from ringproof.llm import decontaminate as d


def words_of(t):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").lower().split()


def brute(docs, items):
    """(pairs that must be found, pairs that may be found): every window and every run of a text by every item."""
    texts = [(i, words_of(t)) for i, t in docs]
    df = Counter(w for _, ws in texts for w in set(ws))
    weight = lambda w: 1 + log((len(docs) + 1) / (df[w] + 1))
    vector = lambda ws: {w: weight(w) * n for w, n in Counter(ws).items()}
    size = lambda v: sqrt(sum(x * x for x in v.values()))

    def holds(item, answer, near):
        share = d.lcs(item, near) / len(item)
        return share >= d.LCS_SHARE or share >= d.PARAPHRASE_SHARE and d.lcs(answer, near) >= d.ANSWER_SHARE * len(answer)

    must, may = set(), set()
    for k, text in items:
        item = words_of(text)
        if not item:
            continue
        tail = words_of(re.split(r"\?|answer:", text, flags=re.I)[-1])
        answer, n = tail if 0 < len(tail) < len(item) else item[-max(3, len(item) // 5) :], len(item)
        width = d.GRAM if n > d.SHORT else d.SHORT_GRAM
        grams = {tuple(item[p : p + width]) for p in range(n - width + 1)}
        passages = [vector(item[p : p + d.PASSAGE]) for p in d.passage_starts(n, d.PASSAGE)]
        for i, ws in texts:
            for s in d.passage_starts(len(ws), d.PASSAGE // 2) if ws else []:
                v = vector(ws[s : s + d.PASSAGE])
                cosine = max(sum(x * p.get(w, 0) for w, x in v.items()) / size(v) / size(p) for p in passages)
                near = ws[max(0, s - n) : s + d.PASSAGE + n]
                if cosine > d.COSINE + 1e-4 and holds(item, answer, near):
                    must.add((i, k))
                if cosine > d.COSINE - 1e-4 and holds(item, answer, near):
                    may.add((i, k))
            for p in range(len(ws) - width + 1):
                if tuple(ws[p : p + width]) in grams:
                    if holds(item, answer, ws[max(0, p - n) : p + 2 * n]):
                        must.add((i, k))
                    if holds(item, answer, ws[max(0, p - 2 * n) : p + 3 * n + width]):
                        may.add((i, k))
    return must, must | may


@pytest.mark.parametrize("n_docs", [1, 5, 40, 200])
@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_against_brute_force(spark, n_docs, share):
    """Items in one document, a tenth or all; short and equal items; null ids; repeated rows; texts of one word and of many."""
    r = random.Random(n_docs * 10 + int(share * 10))
    text = lambda n: [f"v{r.randrange(300)}" for _ in range(n)]
    items = [(1, text(30)), (2, text(4)), (3, text(2)), (4, text(130)), (None, text(20)), (6, ["What", "is", *text(12), "?", *text(3)])]
    items += [(7, items[0][1]), (8, ["v1"] * 9), (9, ["solo"])]
    docs = []
    for i in range(n_docs):
        ws = text(r.choice([1, 20, 48, 49, 150]))
        if i == 0 or r.random() < share:
            k, keep = i % 6, r.choice([1, 0.85, 0.7]) if i else 1
            own = [w for w in items[k][1] if len(items[k][1]) < 6 or r.random() < keep]
            ws = ws + own + text(r.choice([0, 30]))
        docs.append((i if i % 9 != 8 else None, " ".join(ws)))
    docs += [docs[0], (5000, None), (5001, ""), (5002, " .,")]
    items = [(k, " ".join(ws)) for k, ws in items] + [(100, None), (101, ""), (102, "?!")]
    must, may = brute(docs, items)
    assert {k for i, k in must if i == 0} >= {1, 7}
    frame = lambda rows, *names: spark.createDataFrame(rows, f"{names[0]} long, text string")
    found = d.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), block_words=100 if n_docs == 40 else d.BLOCK_WORDS).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert len(found) == len(got) and must <= got <= may


def test_no_window_is_passed_over(spark):
    """The search by cosine finds just what a plain sum over words finds, run over many texts at once."""
    import numpy as np

    r = random.Random(3)
    items = [(i, " ".join(f"v{r.randrange(200)}" for _ in range(r.randint(3, 90)))) for i in range(60)]
    words, weight = d.Words(), np.random.default_rng(1).uniform(1, 9, d.BUCKETS)
    lists = [words.read(t) for _, t in items]
    passages = [(k, d.buckets_of(w[p : p + d.PASSAGE])) for k, w in enumerate(lists) for p in d.passage_starts(len(w), d.PASSAGE)]
    kinds = np.unique(np.concatenate([b for _, b in passages]))
    a = np.array([[weight[b] * (own == b).sum() for b in kinds] for _, own in passages])
    block = d.Block(items, weight, {0: (kinds, np.linalg.svd(a, full_matrices=False)[2].T, None)})
    block.judge = lambda k, near: (1.0, 1.0)
    texts = [words.read(" ".join(f"v{r.randrange(400)}" for _ in range(n))) for n in [0, 1, 5, 47, 48, 49, 72, 73, 200, 0, 300]]
    best: dict = {}
    sizes = np.array([len(t) for t in texts])
    block.by_cosine(np.concatenate(texts), np.cumsum(sizes) - sizes, np.cumsum(sizes), best)
    want: dict = {}
    for t, ids in enumerate(texts):
        for s in d.passage_starts(len(ids), d.PASSAGE // 2) if len(ids) else []:
            b = d.buckets_of(ids[s : s + d.PASSAGE])
            v = np.array([weight[k] * (b == k).sum() for k in kinds])
            for (k, _), row in zip(passages, a):
                c = float(row @ v / np.linalg.norm(row) / d.norm(b, weight))
                if c >= d.COSINE:
                    want[t, k] = max(want.get((t, k), 0), c)
    assert want.keys() == best.keys() and all(abs(best[x][2] - c) < 1e-4 for x, c in want.items())


def test_paraphrase_recall(spark):
    """Words dropped, swapped with their neighbour, or replaced; the answer kept. At least nine tenths are found, no clean text is."""
    r = random.Random(11)
    text = lambda n: [f"w{r.randrange(60 if r.random() < 0.4 else 5000)}" for _ in range(n)]
    items = {i: [*text(r.randint(10, 50)), "?", *text(4)] for i in range(80)}

    def changed(ws):
        head, tail = [w for w in ws[:-5] if r.random() > 0.1], ws[-4:]
        for p in range(0, len(head) - 1, 7):
            head[p], head[p + 1] = head[p + 1], head[p]
        return [w if r.random() > 0.08 else "other" for w in head] + tail

    docs = [(i, " ".join(text(60) + changed(ws) + text(60))) for i, ws in items.items()] + [(1000 + i, " ".join(text(150))) for i in range(120)]
    rows = [(i, " ".join(ws)) for i, ws in items.items()]
    found = {(x.doc_id, x.item_id) for x in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()}
    caught = sum((i, i) in found for i in items) / len(items)
    print("paraphrase recall", caught)
    assert caught >= 0.9 and not [x for x in found if x[0] >= 1000]
