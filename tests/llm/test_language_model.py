"""The recurrent model: slopes against differences, probabilities, carried state, and scores that don't hang on partitions."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringproof.llm import language_model as m


@pytest.fixture(scope="module")
def shape():
    counts = np.sort(np.random.default_rng(1).integers(1, 500, 7000))[::-1]
    return m.Shape(np.arange(7000) * 37 - 999, counts, int(counts.sum()) + 900, 7500)


def some_docs(n, seed=2):
    r = np.random.default_rng(seed)
    return [np.where(r.random(k) < 0.1, m.OTHER, r.zipf(1.3, k) % 7000).astype(np.uint16) for k in r.integers(1, 90, n)]


def wide(p):
    return {k: v.astype(np.float64) for k, v in p.items()}


def test_slopes(shape):
    r = np.random.default_rng(3)
    p = {k: v + r.normal(0, 0.3, v.shape) for k, v in wide(m.initial(shape)).items()}
    ids = r.integers(0, 7000, (5, 4)).astype(np.uint16)
    ids[1, 2] = m.OTHER
    x, keep = shape.inputs[ids], (r.random((5, 4)) > 0.3).astype(np.float64)
    classes, words = shape.classes[np.roll(ids, 1)].ravel(), ids.ravel() % m.WIDTH

    def loss(slopes=None):
        hs, back = m.forward(p, x, keep, np.full((m.HIDDEN, 4), 0.2))
        logs, dh = m.outputs(p, hs.reshape(m.HIDDEN, -1), classes, words, slopes)
        if slopes is not None:
            m.backward(p, x, keep, back, dh.reshape(hs.shape), slopes)
        return -logs.mean()

    slopes: dict = {}
    loss(slopes)
    at, g = slopes["x"]
    dense = np.zeros_like(p["x"])
    dense[:, at] = g
    slopes["x"] = dense
    for k, v in p.items():
        for i in np.argsort(-np.abs(slopes[k]).ravel())[:6].tolist() + [0]:
            old, at = v.flat[i], 1e-5
            v.flat[i] = old + at
            up = loss()
            v.flat[i] = old - at
            down = loss()
            v.flat[i] = old
            assert slopes[k].flat[i] == pytest.approx((up - down) / (2 * at), abs=1e-7, rel=1e-4), k


def test_probabilities_sum_to_one(shape):
    p = wide(m.initial(shape))
    h = np.random.default_rng(4).normal(0, 0.5, (m.HIDDEN, 1))
    places = np.arange(7000)
    logs, _ = m.outputs(p, np.repeat(h, 7001, axis=1), shape.classes[np.append(places, m.OTHER)], np.append(places, 0) % m.WIDTH)
    inside = np.exp(logs[:7000] + math.log(10) * shape.share)
    # 500 kinds of tokens outside the table and one that is never seen share the last class.
    outside = np.exp(logs[7000]) * (900 + m.SMOOTH * 501) / shape.mass[-1]
    assert inside.sum() + outside == pytest.approx(1, abs=1e-9)


def test_state_is_carried_over_windows(shape, monkeypatch):
    p, docs = wide(m.initial(shape)), some_docs(30)
    docs.append(np.concatenate(docs * 3))
    want = m.walk(p, shape, docs)
    for steps, most, lanes in ((1, 1, 512), (7, 7, 3), (4096, 4096, 1)):
        monkeypatch.setattr(m, "STEPS", steps)
        monkeypatch.setattr(m, "MOST_STEPS", most)
        assert np.allclose(m.walk(p, shape, docs, n_lanes=lanes), want, atol=1e-8)
    alone = m.walk(p, shape, docs[-1:])
    assert alone[0] == pytest.approx(want[-1], abs=1e-8)


def test_scores_do_not_hang_on_partitions(spark):
    """The same scores from 1, 4 and 16 partitions, with several learners; documents held out score above the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"])
    docs = docs.unionByName(spark.createDataFrame([(900001, None), (None, "a b c"), (900002, "")], "doc_id long, text string"))
    got = []
    for n in (1, 4, 16):
        rows = m.scored(docs.repartition(n), shard_tokens=100_000).select("id", "held_out", "n_tokens", "base_score", "score").collect()
        got.append({r.id: r for r in rows})
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        assert max(abs(other[i].score - r.score) / r.n_tokens for i, r in got[0].items()) < 1e-4
        assert max(abs(other[i].base_score - r.base_score) for i, r in got[0].items()) < 1e-5
    held = [r for r in got[2].values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    model, base = sum(r.score for r in held) / tokens, sum(r.base_score for r in held) / tokens
    print("held out, log10 a token:", model, "base", base)
    assert model > base + 0.05


def test_repeated_rows_keep_a_row_each(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(2, "a"), (None, None), (None, None)], "doc_id long, text string").withColumn("key", F.lit("clash"))
    rows = m.scored(docs, shard_tokens=20).collect()
    assert len(rows) == 53 and len({r.score for r in rows if r.id == 1}) == 1 and all(r.score < 0 for r in rows)
