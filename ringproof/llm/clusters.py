"""Centroid clustering with JVM-native expressions.

Vectors become arrays of whole numbers. For each centroid, a literal array, zip_with and aggregate compute the squared
distance; array_min of (distance, number) structs chooses the cluster, ties to the smaller number; sums of the
components by cluster, combined before the shuffle, give the next centroids. A round reads the written vectors once and
brings at most `k` rows of sums to the driver, whatever the number of vectors; nothing else is gathered.

Defined results: vectors that are null, have not exactly `size` components, or have a null or non-finite one are left
out. Rows that repeat a vec_id are vectors of their own; of equal hashes that with the smaller components starts first.
A null vec_id is hashed as the empty text. With fewer vectors than `k` there are fewer centroids; of no vectors, no rows.
Whole numbers beyond 2**27 count as 2**27 (so that a distance fits a long); a sum of distances that fits no long is null.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SIZE = 64
SCALE = 64
K = 16
ROUNDS = 3
SEED = 1
LARGEST = 1 << 27


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the kept vectors, each component x as floor(scale * x)."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    number = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long")
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = picked.where(F.when(F.size("x") == size, F.forall("x", finite)).otherwise(False))
    return kept.select("vec_id", F.transform("x", number).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hashes; Spark keeps k rows a task."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def _literal(centroid: list[int]) -> str:
    return f"array({', '.join(f'{x}L' for x in centroid)})"


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """A struct: distance (squared) and cluster of the nearest centroid."""
    to = lambda c: f"aggregate(zip_with({v}, {_literal(c)}, (x, c) -> (x - c) * (x - c)), 0L, (a, x) -> a + x)"
    return F.expr(f"array_min(array({', '.join(f'struct({to(c)} as distance, {i} as cluster)' for i, c in enumerate(centroids))}))")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round; empty ones stay."""
    size = len(centroids[0])
    placed = vectors.select("v", nearest("v", centroids)["cluster"].alias("cluster"))
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(v[{i}]) as s{i}") for i in range(size)])
    out = list(centroids)
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array): a row for each kept vector."""
    scratch = Scratch(vectors.sparkSession, "clusters")
    known = scratch.save(whole(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(known, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(known, centroids)
    if not centroids:
        centroids = [[0] * size]  # of no vectors; no row gets it
    placed = scratch.save(known.select("vec_id", nearest("v", centroids).alias("best")).select("vec_id", "best.cluster", "best.distance"), "placed")
    sums = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row a centroid
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return placed.withColumns({
        "cluster_inertia": of([fits(sums.get(i, 0)) for i in range(len(centroids))]),
        "inertia": fits(total),
        "centroid_sha256": of([F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]),
        "centroid": of([F.expr(_literal(c)) for c in centroids]),
    })


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _place_sql(i: int) -> str:
    """The nearest centroid c of each row r, at distance d."""
    return f"""a{i} as materialized (
  select r, min(d) as d, arg_min(c, (d, c)) as c from (
    select v.r, c.c, list_sum(list_transform(range(1, {SIZE + 1}), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))::bigint as d from v cross join c{i} c)
  group by r
)"""


def _move_sql(i: int) -> str:
    floor = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
    return f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(n.v, c{i}.v) as v from c{i} left join (
    select c, list(x order by j) as v from (
      select a.c, j, {floor} as x from (select r, unnest(v) as x, generate_subscripts(v, 1) as j from v) e join a{i} a on e.r = a.r group by a.c, j)
    group by c) n on c{i}.c = n.c
)"""


_STEPS_SQL = ", ".join(f"{_place_sql(i)}, {_move_sql(i)}" for i in range(ROUNDS))
OP12_SQL = f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE}
), v as materialized (
  select row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, '')), v) as r, vec_id, v from kept
), c0 as materialized (
  select (r - 1)::integer as c, v from v where r <= {K}
), {_STEPS_SQL}, {_place_sql(ROUNDS)}
select v.vec_id, a.c as "cluster", a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia,
       (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from v join a{ROUNDS} a on v.r = a.r join c{ROUNDS} c on a.c = c.c
"""
