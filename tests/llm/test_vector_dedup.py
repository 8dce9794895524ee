"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from touchline.llm import vector_dedup
from touchline.llm.base import table


def brute(rows, cosine=0.95):
    """vec_id, n_links, component_id of each row, in order, by all pairs."""
    n = len(rows)
    link = np.zeros((n, n), bool)
    x = [None if v is None or not len(v) or any(y is None or not np.isfinite(y) for y in v) or not any(v) else np.array(v, np.float64) for _, v in rows]
    x = [None if v is None else v / np.abs(v).max() for v in x]
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                link[i, j] = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    low = {c: min([rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None], default=None) for c in set(label.tolist())}
    return [(rows[i][0], int(link[i].sum()), low[label[i]]) for i in range(n)]


key = lambda x: (x[0] is None, x)


@pytest.mark.parametrize("recall", [0.99, 0.6])
def test_as_all_pairs(spark, odd_folder, recall):
    """Families here are wide enough that most of them have members outside the core; a low recall loses links, but makes none up."""
    vectors = table(spark, odd_folder, "embeddings")
    got = vector_dedup.near_duplicates(vectors, 0.95, recall).collect()
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    text = lambda rows: sorted(rows, key=repr)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    if recall > 0.9:
        assert text([tuple(r)[:3] for r in got]) == text(want)
    else:
        assert sum(r.n_links for r in got) <= sum(x[1] for x in want) and len(got) == len(want)


@pytest.mark.parametrize("noise", [0.004, 0.02, 0.035])
def test_one_large_family(spark, noise):
    """A third of all vectors are near copies of one: within the core, around its edge, and partly not linked with each other."""
    r = np.random.default_rng(1)
    centre, other = r.standard_normal(64) / 8, r.standard_normal((400, 64))
    copies = centre + noise * r.standard_normal((200, 64))
    rows = [(i, list(map(float, v))) for i, v in enumerate([*copies, *other])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, vector_dedup.near_duplicates(frame).select("vec_id", "n_links", "component_id").collect()))
    want = brute(rows)
    found, all_links = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found <= all_links and found >= 0.995 * all_links and all(a[1] <= b[1] for a, b in zip(got, want))
    assert [x[2] for x in got] == [x[2] for x in want]


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.951: most are found, as many as shape() promises; at 0.949 there is no link."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = r.standard_normal(64), r.standard_normal(64)
        a, c = a / np.linalg.norm(a), 0.951 if i < 300 else 0.949
        b -= (a @ b) * a
        rows += [(2 * i, list(map(float, a))), (2 * i + 1, list(map(float, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b))))]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(x.n_links == 0 and x.kept for x in got if x.vec_id >= 600)
    assert sum(x.n_links for x in got if x.vec_id < 600) >= 2 * 300 * 0.97


def test_probability_of_collision():
    r = np.random.default_rng(3)
    for distance in (0.3, 1.0, 1.4):
        at = r.uniform(0, vector_dedup.WIDTH, 100_000)
        same = np.floor(at / vector_dedup.WIDTH) == np.floor((at + distance * r.standard_normal(100_000)) / vector_dedup.WIDTH)
        assert abs(same.mean() - vector_dedup.collides(distance)) < 0.01
