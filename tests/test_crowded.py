"""Crowded cells of the spatial join: the result stays, and what is tested is near it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairngeo.functions import geometry as G
from cairngeo.operators import spatial


def boxes(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "fid long, xmin double, ymin double, xmax double, ymax double")
    return df.withColumn("geom", G.box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def meeting(a, b):
    return sorted((i, k) for i, p in enumerate(a) for k, q in enumerate(b) if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1])


def cluster(seed, count, crowd, size, span=16.0):
    """Boxes of a size: 30 % of them within ``span`` around a place, the others far around."""
    rng, out = random.Random(seed), []
    for i in range(count):
        reach = span if i % 10 < 3 else 20_000.0
        x, y = crowd[0] + rng.uniform(0, reach), crowd[1] + rng.uniform(0, reach)
        out.append((x, y, x + size[0] * rng.uniform(0.7, 1), y + size[1] * rng.uniform(0.7, 1)))
    return out


CASES = {
    "points in small boxes": ((0, 0), (1.5, 1.5), 16.0),
    "thin lines along and across": ((16, 0.01), (0.01, 16), 16.0),
    "boxes in a far smaller place": ((0.001, 0.001), (0.01, 0.01), 0.1),
    "small in large": ((0.5, 0.5), (16, 16), 16.0),
}


@pytest.mark.parametrize("case", CASES)
def test_candidates_are_near_the_result(spark, case):
    a_size, b_size, span = CASES[case]
    a, b = cluster(1, 2400, (5000.0, 5000.0), a_size, span), cluster(2, 1600, (5000.0, 5000.0), b_size, span)
    want = meeting(a, b)
    left, right = boxes(spark, a), boxes(spark, b)
    got = [tuple(r) for r in spatial.spatial_join(left, right).collect()]
    assert sorted(got) == want
    tested = sum(pairs.count() for pairs in spatial.candidates(left, right))
    assert tested <= 6 * len(want) + 8 * (len(a) + len(b)), (tested, len(want))


def test_whole_cells_would_test_far_more(spark, monkeypatch):
    a, b = cluster(1, 2400, (5000.0, 5000.0), (0, 0)), cluster(2, 1600, (5000.0, 5000.0), (1.5, 1.5))
    left, right = boxes(spark, a), boxes(spark, b)
    finer = sum(pairs.count() for pairs in spatial.candidates(left, right))
    monkeypatch.setattr(spatial, "ROUNDS", 0)
    assert sum(pairs.count() for pairs in spatial.candidates(left, right)) > 5 * finer


def test_features_on_one_spot_are_not_cut(spark):
    a, b = [(5.0, 5.0, 5.0, 5.0)] * 300, [(5.0 - i / 100, 5.0 - i / 100, 5.5, 5.5) for i in range(40)]
    left, right = boxes(spark, a), boxes(spark, b)
    assert sum(pairs.count() for pairs in spatial.candidates(left, right, width=64.0)) == 300 * 40 == spatial.spatial_join(left, right, width=64.0).count()


def test_crowds_across_the_origin_and_cell_borders(spark):
    rng = random.Random(9)
    a = [(x, y, x + rng.choice([0, 0.1, 3]), y + rng.choice([0, 0.1, 3])) for x, y in ((rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(700))]
    a += [(i / 8, k / 8, i / 8 + 0.125, k / 8 + 0.125) for i in range(-8, 8) for k in range(-8, 8)]
    got = [tuple(r) for r in spatial.spatial_join(boxes(spark, a), boxes(spark, a[::2]), width=0.5).collect()]
    assert sorted(got) == meeting(a, a[::2])
