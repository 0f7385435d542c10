"""Nearest centroids through balls against all centroids."""

import random

import pytest

from worklens.operators import vectors


def made(spark, rng, n, spread):
    centres = []
    for i in range(n):
        middle = [rng.randrange(4) / 4 for _ in range(8)]
        centres.append((i, [min(spread, max(0.0, m * spread + rng.gauss(0, 0.02))) for m in middle], rng.randint(1, 5)))
    rows = [(i, [rng.random() * spread for _ in range(8)]) for i in range(60)] + [(100 + i, list(centres[i][1])) for i in range(20)]
    return spark.createDataFrame(rows, "rid long, vector array<double>"), spark.createDataFrame(centres, "name long, centroid array<double>, members int")


def picked(df):
    return {r["rid"]: [(round(n["distance"], 12), n["name"], n["members"]) for n in r["nearest"]] for r in df.collect()}


@pytest.mark.parametrize(("k", "spread"), [(1, 1.0), (4, 1.0), (2, 6.0)])
def test_balls_leave_no_nearest_out(spark, k, spread):
    rows, centres = made(spark, random.Random(k), 700, spread)
    whole = picked(vectors.nearest_in_space(rows, centres, "rid", "name", k))
    assert len(whole) == 80 and all(len(n) == k for n in whole.values())
    assert whole == picked(vectors.nearest_in_space(rows, centres, "rid", "name", k, block=32, most_balls=24))


def test_far_balls_are_not_met(spark):
    rng = random.Random(7)
    _, centres = made(spark, rng, 800, 1.0)
    rows = spark.createDataFrame([(r["name"], r["centroid"]) for r in centres.collect()[:50]], "rid long, vector array<double>")
    _, top = vectors.balls_of(centres, "name", 200, 32)
    met = rows.join(top).select(vectors.reachable_balls(top["__balls"], rows["vector"], 1, 8).alias("b"), top["__balls"].alias("all")).collect()
    assert sum(len(r["b"]) for r in met) < 0.5 * sum(len(r["all"]) for r in met)
