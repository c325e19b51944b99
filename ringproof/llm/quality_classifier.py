"""Quality classifier: a document model, combined with the posteriors of its host and path (hierarchical empirical Bayes).

Document evidence: two logistic models, quality and toxicity, over a few dense measures and the presence of words. They
are fitted on a bounded sample of the labelled documents (FIT_ROWS, those of least id hash); words are those in at
least MIN_DF documents of the sample whose share differs between the classes by LEAST_Z standard errors, at most
VOCABULARY of them.

Sites: the mean evidence of a host (over all its documents) is shrunk toward the global mean, that of a path toward
its host's posterior; the strength of each prior is estimated from the spread between sites by the method of moments,
so sparse sites stay near their prior. A document's own evidence is taken out of its sites before they are used. Sums
are grouped with partial aggregation, so a host with a third of all rows is no special case.

A document is accepted if its posterior quality is at least 0.5 and its toxicity below 0.5.

Defined results: null texts are empty texts; null hosts or paths form a site of their own; unlabelled tables (or tables
without one of the classes) give posteriors of the prior and accept every document; rows that repeat a doc_id keep a row
each; conflicting labels of a document count each.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_sized, map_arrow, table

FIT_ROWS = 12_000
VOCABULARY = 30_000
MIN_DF = 5
#: A word counts only if its share differs between the classes by this many standard errors.
LEAST_Z = 4.0
STEPS = 150
_NO_CAPITALS = bytes(range(65, 91))
_FOLD = bytes(32 if chr(i) in "\".,;:!?|#*$%&()[]{}<>'" else i + 32 if 65 <= i <= 90 else i for i in range(256))
N_DENSE = 8
TARGETS = ("quality", "toxic")


def evidence(text: str | None) -> tuple[list[float], set[bytes]]:
    """(dense measures, each about 0 to 1; the distinct words, lower-cased and bare)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    pairs = len(set(zip(words, words[1:])))
    dense = [min(1.0, 5 * gone(b"#*$%&|<>") / n), min(1.0, 5 * gone(_NO_CAPITALS) / size), min(1.0, gone(b"!") / n), 1 - kinds / n, 1 - (pairs + 1) / n if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, size / n / 20), 1 / n**0.5]
    return dense, set(data.translate(_FOLD).split())


def fit_logistic(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, width: int, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights (bias, dense, words) by gradient steps with a scale for each weight; rows and cols: the words present."""
    w, scale = np.zeros(1 + x.shape[1] + width), np.zeros(1 + x.shape[1] + width)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[0] = np.log(share / (1 - share))
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both classes count alike in the slopes
    cost /= cost.mean()
    for _ in range(steps):
        z = w[0] + x @ w[1 : 1 + x.shape[1]] + np.bincount(rows, w[1 + x.shape[1] + cols], len(y))
        g = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.concatenate(([g.sum()], x.T @ g, np.bincount(cols, g[rows], width))) + np.concatenate(([0.0], w[1:]))
        scale += slope**2
        w -= 0.5 * slope / np.sqrt(scale + 1e-9)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, the targets (0, 1 or null), dense, words: the evidence of at most fit_rows labelled documents. docs: id, text."""
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), *[(F.col(t) > 0).cast("int").alias(t) for t in TARGETS])
    # At most fit_rows ids: a proven bound for the broadcast.
    picked = known.orderBy(F.xxhash64("id"), "id", *TARGETS).limit(fit_rows)

    def make():
        def run(rows):
            found = [evidence(t) for t in rows["text"]]
            return {n: rows[n] for n in ("id", *TARGETS)} | {"dense": [f[0] for f in found], "words": [sorted(f[1]) for f in found]}

        return run

    return map_arrow(docs.join(F.broadcast(picked), "id").select("id", *TARGETS, "text"), make, "id long, " + ", ".join(f"{t} int" for t in TARGETS) + ", dense array<double>, words array<binary>")


def fit(sample: DataFrame, target: str) -> dict | None:
    """The model of a target; None if a class is missing. The driver gets at most VOCABULARY words and, of each sampled document, the numbers of those."""
    rows = sample.where(F.col(target).isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("n1")).first()
    n, n1 = counts["n"], counts["n1"] or 0
    if not 0 < n1 < n:
        return None
    words = rows.select(target, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("n1")).where((F.col("n") >= MIN_DF) & (F.col("n") < 0.5 * n))
    share = (F.col("n") + 0.5) / n
    z = F.abs(F.col("n1") / n1 - (F.col("n") - F.col("n1")) / (n - n1)) / F.sqrt(share * (1 - F.col("n") / (n + 1)) * (1 / n1 + 1 / (n - n1)))
    chosen = [bytes(r["word"]) for r in words.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()]
    shared = sample.sparkSession.sparkContext.broadcast(chosen)

    def make():
        at = {w: i for i, w in enumerate(shared.value)}
        return lambda rows: {"id": rows["id"], "y": rows["y"], "dense": rows["dense"], "words": [[at[w] for w in ws if w in at] for ws in rows["words"]]}

    got = map_arrow(rows.select("id", F.col(target).alias("y"), "dense", "words"), make, "id long, y int, dense array<double>, words array<int>").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: (got["id"][i], got["y"][i], got["dense"][i]))
    words_of = [got["words"][i] for i in order]
    rows_at = np.repeat(np.arange(len(order)), [len(w) for w in words_of])
    weights = fit_logistic(np.array([got["dense"][i] for i in order]), rows_at, np.array([w for ws in words_of for w in ws], np.int64), len(chosen), np.array([got["y"][i] for i in order], float))
    return {"weights": weights, "words": {w: i for i, w in enumerate(chosen)}}


def scores(docs: DataFrame, models: dict[str, dict | None], keep: list[str]) -> DataFrame:
    """keep and a probability column for each model (0.5 where there is none). docs: keep and text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def make():
        names = list(shared.value)
        tables = {n: (m["weights"][: 1 + N_DENSE], {w: float(m["weights"][1 + N_DENSE + i]) for w, i in m["words"].items()}) for n, m in shared.value.items() if m}

        def run(rows):
            out = {k: rows[k] for k in keep} | {n: [] for n in names}
            for text in rows["text"]:
                dense, words = evidence(text)
                for n in names:
                    if n not in tables:
                        out[n].append(0.5)
                        continue
                    w, table_of = tables[n]
                    z = w[0] + float(np.dot(w[1:], dense)) + sum(table_of[x] for x in words if x in table_of)
                    out[n].append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
            return out

        return run

    return map_arrow(docs, make, ", ".join(f"`{k}` {fields[k]}" for k in keep) + "".join(f", {n} double" for n in models))


def site_posteriors(scored: DataFrame, target: str) -> DataFrame:
    """host, path, and for each path: n, s (its evidence), host_n, host_s, and the global numbers that shrinking needs."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("ss"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("ss").alias("host_ss"))
    total = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"), F.sum("host_ss").alias("all_ss"), F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("between"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn"))
    inner = paths.join(hosts, "host").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_between"), F.count(F.lit(1)).alias("paths"))
    return paths.join(hosts, "host").join(F.broadcast(total), how="cross").join(F.broadcast(inner), how="cross")  # each of the two is one row


def _strength(between: Column, within: Column, groups: Column, n: Column) -> Column:
    """Prior strength, in documents, by moments: the variance within sites over the variance between them that chance doesn't explain."""
    v_in = within / F.greatest(n - groups, F.lit(1))
    v_out = (between / F.greatest(groups - 1, F.lit(1)) - v_in) / F.greatest(n / F.greatest(groups, F.lit(1)), F.lit(1.0))
    return F.least(F.greatest(v_in / F.greatest(v_out, F.lit(1e-6)), F.lit(5.0)), F.lit(100_000.0))


def with_posterior(scored: DataFrame, sites: DataFrame, target: str) -> DataFrame:
    """scored and {target}_posterior. The document's own evidence p is left out of its sites."""
    joined = join_sized(scored, sites, ["_host", "_path"], "left")
    p = F.col(target)
    mean = F.col("all_s") / F.col("all_n")
    k_host = _strength(F.col("between") - F.col("all_s") * mean, F.col("all_ss") - F.col("between"), F.col("hosts"), F.col("all_n"))
    k_path = _strength(F.col("path_between") - F.col("between"), F.col("all_ss") - F.col("path_between"), F.col("paths"), F.col("all_n"))
    host = (k_host * mean + F.col("host_s") - p) / (k_host + F.col("host_n") - 1)
    path = (k_path * host + F.col("s") - p) / (k_path + F.col("n") - 1)
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(bound(c) / (1 - bound(c)))
    z = logit(p) + logit(path) - logit(mean)
    return joined.withColumn(f"{target}_posterior", 1 / (1 + F.exp(-z))).drop("n", "s", "ss", "host_n", "host_s", "host_ss", "all_n", "all_s", "all_ss", "between", "hosts", "nn", "path_between", "paths")


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A row for each row of docs: the columns in keep, _host, _path, quality, toxic (document evidence), their posteriors, accepted."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality-classifier")
    keep = keep or []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = scratch.save(labelled_sample(texts, labels, fit_rows), "sample")
    models = {t: fit(sample, t) for t in TARGETS}
    named = {f"_rp_{i}": c for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()], F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"), F.col(text_col).alias("text"))
    out = fixed = scratch.save(scores(rows, models, [*named, "_host", "_path"]), "evidence")
    for t in TARGETS:
        sites = scratch.save(site_posteriors(fixed.select(F.col("_host").alias("host"), F.col("_path").alias("path"), t), t).withColumnsRenamed({"host": "_host", "path": "_path"}), f"sites-{t}")
        out = with_posterior(out, sites, t)
    out = out.withColumn("accepted", (F.col("quality_posterior") >= 0.5 if models["quality"] else F.lit(True)) & (F.col("toxic_posterior") < 0.5 if models["toxic"] else F.lit(True)))
    return out.withColumnsRenamed(named)


def document_sites() -> tuple[Column, Column]:
    """documents have no address: the source stands for the host, source and language for the path."""
    return F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def page_sites(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return host, F.concat_ws("/", host, F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^/?#]*)", 1))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classified(docs, table(spark, sf_dir, "labels"), *document_sites(), keep=["doc_id"])
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("quality", "toxic", "quality_posterior", "toxic_posterior")], F.col("accepted").alias("kept"))
