"""Near duplicates among embeddings by Euclidean p-stable hashing, then exact cosines.

How it scales
1. Equal vectors are one class from here on, however many there are.
2. In each of L tables a normalised vector's bucket is that of k random projections, quantised at ``WIDTH``. k grows with the logarithm of the number
   of classes, so that unrelated vectors rarely meet, and L is what finds a pair at the threshold itself with probability ``recall`` (nearer
   ones are found more surely). A row of a table is a bucket, a class and a 64-bit sketch of signs, not a vector.
3. Each bucket ties its members to its smallest one, and vectors of a tie are compared; classes tied by such links are a family. A member within
   half the threshold's angle of its family's centre is a core member: by the triangle inequality all core members link with each
   other, so their links are counted without any pair being made. A great family of near copies thus costs its size.
4. Only pairs of a bucket that aren't of one core remain. They are joined by bucket, filtered by the sketch (a pair at the threshold fails it once in
   10 ** 5) and compared exactly. Cores of different families meet only where their centres allow a link.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, link with nothing. Every row is a
vector, rows with one vec_id too; a null vec_id takes part and is never a representative unless its component has no other id; an empty
table has no rows; columns other than vec_id and the embedding are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as T
from .base import components, stage

WIDTH = 2.0
SEED = 20_231
#: bits in which the sketches of a pair at a cosine of 0.95 may differ: 6.5 are expected, with a deviation of 2.4
SKETCH_BITS = 17
#: angles are known to this, in radians
MARGIN = 1e-6


def collides(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is the same for two points at a distance (Datar et al., 2004)."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections of a table, and tables, for n vectors."""
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(collides(math.sqrt(2)))))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(collides(math.sqrt(2 - 2 * cosine)) ** k)))


@lru_cache(maxsize=4)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed normal projections, offsets, and the directions of the sketch's 64 signs."""
    r = np.random.default_rng([SEED, dim, k, tables])
    return r.standard_normal((dim, k * tables)), r.uniform(0, WIDTH, k * tables), r.standard_normal((dim, 64))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: rows and their unit vectors, of those that can link."""
    column = column.cast(pa.large_list(pa.float64()))
    lens, flat = np.asarray(column.value_lengths().fill_null(0)), column.flatten()
    values = np.asarray(flat.fill_null(math.nan), dtype=np.float64)
    begins = np.cumsum(lens) - lens
    for dim in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == dim)
        x = values[begins[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        rows, x = rows[good], x[good]
        x = x / np.abs(x).max(axis=1, keepdims=True) + 0.0
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> vec_id, unit vector in bytes (null if it can't link)."""
    for batch in batches:
        out = [None] * len(batch)
        for rows, x in _vectors(batch.column(1)):
            for i, v in zip(rows.tolist(), x, strict=True):
                out[i] = v.tobytes()
        yield pa.record_batch({"vec_id": batch.column(0), "unit": pa.array(out, pa.binary())})


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: rows and vectors of a column of unit vectors in bytes."""
    data = column.to_pylist()
    lens = np.array([len(x) for x in data])
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        yield rows, np.frombuffer(b"".join(data[i] for i in rows), np.float64).reshape(len(rows), -1)


def _buckets(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, unit -> bucket, node, sketch: a row for each table."""
        for batch in batches:
            node = batch.column(0).to_numpy()
            for rows, x in _matrices(batch.column(1)):
                a, b, signs = _projections(x.shape[1], k, tables)
                cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(rows), tables, k).astype(np.uint64)
                with np.errstate(over="ignore"):
                    bucket = np.full((len(rows), tables), x.shape[1], np.uint64) + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for i in range(k):
                        bucket = T.mix(bucket ^ (cells[:, :, i] * np.uint64(0xD1342543DE82EF95) + np.uint64(i)))
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)[:, 0]
                yield pa.record_batch({"bucket": bucket.reshape(-1).view(np.int64), "node": np.repeat(node[rows], tables), "sketch": np.repeat(sketch, tables)})

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their unit vectors (of one length) -> a, b, cosine."""
    for batch in batches:
        for (rows, x), (_, y) in zip(_matrices(batch.column(2)), _matrices(batch.column(3)), strict=True):
            yield pa.record_batch({"a": batch.column(0).take(pa.array(rows)), "b": batch.column(1).take(pa.array(rows)), "cosine": np.einsum("ij,ij->i", x, y)})


def _cosines(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, cosine of distinct pairs of classes."""
    unit = lambda c: classes.select(F.col("node").alias(c), F.col("unit").alias(f"unit_{c}"))
    return pairs.join(unit("a"), "a").join(unit("b"), "b").where("octet_length(unit_a) = octet_length(unit_b)").select("a", "b", "unit_a", "unit_b").mapInArrow(_compared, "a long, b long, cosine double")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """family, vector in bytes -> family, sum of the vectors of each run of one family, if they are of one length."""
    now, total = None, None
    for batch in batches:
        done = []
        for family, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(data, np.float64)
            if family != now:
                if now is not None:
                    done.append((now, total.tobytes()))
                now, total = family, x.copy()
            else:
                total += x
        if done:
            yield pa.record_batch(list(map(pa.array, zip(*done, strict=True))), names=["family", "centre"])
    if now is not None:
        yield pa.record_batch({"family": [now], "centre": pa.array([total.tobytes()], pa.binary())})


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, family, unit, centre -> node, family, angle to the centre."""
    for batch in batches:
        for (rows, x), (_, c) in zip(_matrices(batch.column(2)), _matrices(batch.column(3)), strict=True):
            cosine = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
            yield pa.record_batch({"node": batch.column(0).take(pa.array(rows)), "family": batch.column(1).take(pa.array(rows)), "angle": np.arccos(np.clip(cosine, -1, 1))})


def _cores(family: DataFrame, classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """node, family, angle of core members; family and the centre's direction. ``family``: node, component."""
    members = stage(family.withColumnRenamed("component", "family").join(classes.select("node", "unit"), "node"), "vectors-families")
    sums = members.select("family", "unit").sortWithinPartitions("family").mapInArrow(_sums, "family long, centre binary")
    centres = stage(sums.repartition("family").sortWithinPartitions("family").mapInArrow(_sums, "family long, centre binary"), "vectors-centres")
    angles = members.join(centres, "family").select("node", "family", "unit", "centre").mapInArrow(_angles, "node long, family long, angle double")
    return stage(angles.where(F.col("angle") <= math.acos(cosine) / 2 - MARGIN), "vectors-cores"), centres


def links(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What links among ``vectors`` (vec_id, embedding): ``rows`` (vec_id, unit), ``classes`` of equal vectors (node, unit, weight, low), ``pairs``
    of classes (a, b) with that cosine at least which aren't of one core, and ``cores`` (node, family): all members of one link."""
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_unit, "vec_id long, unit binary"), "vectors-rows")
    same = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    classes = stage(same.withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    k, tables = shape(classes.count(), cosine, recall)
    keys = stage(classes.select("node", "unit").mapInArrow(_buckets(k, tables), "bucket long, node long, sketch long"), "vectors-buckets")
    met = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "sketch")).alias("pivot")).where("n > 1").drop("n")
    shared = stage(keys.join(met, "bucket"), "vectors-shared")
    alike = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= SKETCH_BITS
    ties = shared.select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot.sketch").alias("s"), "sketch").where("a <> b").where(alike("s", "sketch")).select("a", "b").distinct()
    family = components(_cosines(ties, classes).where(F.col("cosine") >= cosine))
    cores, centres = _cores(family, classes, cosine)
    flagged = stage(shared.select("bucket", "node", "sketch").join(cores.select("node", "family"), "node", "left"), "vectors-flagged")
    return rows, classes, _outside(flagged, classes, cores, centres, cosine), cores.select("node", "family")


def _outside(flagged: DataFrame, classes: DataFrame, cores: DataFrame, centres: DataFrame, cosine: float) -> DataFrame:
    """a, b (a < b) of the pairs that share a bucket, aren't of one core and have the cosine."""
    named = lambda df, c: df.select("bucket", F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("family").alias(f"family_{c}"))
    alike = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) <= SKETCH_BITS
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    free, core = flagged.where("family is null"), flagged.where("family is not null")
    found = [named(free, "a").join(named(free, "b"), "bucket").where("a < b").where(alike).select("a", "b")]
    found.append(named(free, "a").join(named(core, "b"), "bucket").where(alike).select(*ends))
    # two cores: centres in one bucket of members, near enough for a link
    by_bucket = core.select("bucket", "family").distinct()
    both = by_bucket.withColumnRenamed("family", "a").join(by_bucket.withColumnRenamed("family", "b"), "bucket").where("a < b").select("a", "b").distinct()
    reach = cores.groupBy("family").agg(F.max("angle").alias("reach"))
    centre = centres.withColumnRenamed("family", "node").withColumnRenamed("centre", "unit")
    length = F.col("cosine") / F.sqrt(F.col("aa") * F.col("bb"))
    norm = _cosines(centre.select(F.col("node").alias("a"), F.col("node").alias("b")), centre).select(F.col("a").alias("f"), F.col("cosine").alias("nn"))
    near = _cosines(both, centre).join(norm.withColumnsRenamed({"f": "a", "nn": "aa"}), "a").join(norm.withColumnsRenamed({"f": "b", "nn": "bb"}), "b")
    near = near.join(reach.withColumnsRenamed({"family": "a", "reach": "ra"}), "a").join(reach.withColumnsRenamed({"family": "b", "reach": "rb"}), "b")
    near = near.where(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), length))) <= F.col("ra") + F.col("rb") + math.acos(cosine) + MARGIN).select(F.col("a").alias("family_a"), F.col("b").alias("family_b"))
    found.append(named(core, "a").join(near, "family_a").join(named(core, "b"), ["bucket", "family_b"]).where(alike).select(*ends))
    pairs = found[0].unionByName(found[1]).unionByName(found[2]).distinct()
    return stage(_cosines(pairs, classes).where(F.col("cosine") >= cosine).select("a", "b"), "vectors-pairs")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors that it links with), component_id (the smallest vec_id reachable by links, its own included), kept."""
    rows, classes, pairs, cores = links(vectors, cosine, recall)
    weight = classes.select("node", "weight")
    sizes = cores.join(weight, "node").groupBy("family").agg(F.sum("weight").alias("n"))
    inside = cores.join(sizes, "family").join(weight, "node").select("node", (F.col("n") - F.col("weight")).alias("n"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weight, F.col("b") == F.col("node")).select(F.col("a").alias("node"), F.col("weight").alias("n"))
    linked = inside.unionByName(ends).groupBy("node").agg(F.sum("n").alias("linked"))
    edges = pairs.unionByName(cores.join(cores.groupBy("family").agg(F.min("node").alias("first")), "family").select(F.col("node").alias("a"), F.col("first").alias("b")))
    group = components(edges)
    of_class = classes.join(linked, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    told = of_class.join(low, "component").select("unit", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.where("unit is not null").join(told, "unit").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
