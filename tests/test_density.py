"""Clusters over all segments of a user against all pairs."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_cohesion import T0, segments
from worklens.operators import density, tasks


def by_all_pairs(df, eps):
    s = tasks.with_tokens(df)
    pairs = s.alias("p").join(s.alias("c"), F.expr("p.user_id = c.user_id AND (p.start_time < c.start_time OR (p.start_time = c.start_time AND p.segment_no < c.segment_no))"))
    parts = tasks.similarity(lambda n: F.col(f"p.{n}"), lambda n: F.col(f"c.{n}"))
    links = pairs.where(1.0 - tasks.total_similarity(parts) <= eps).select("p.user_id", "p.segment_no", F.col("c.segment_no").alias("other")).collect()
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for user, a, b in links:
        a, b = find((user, a)), find((user, b))
        up[max(a, b)] = min(a, b)
    return len(links), lambda user, n: find((user, n))


def made(spark, rng, users, minutes, steady):
    rows = []
    for user, n in users.items():
        for r in segments(rng, 0, n, minutes):
            d = r.asDict() | {"user_id": user}
            if rng.random() < steady:  # few different measures, so that cells hold several segments and distances meet bounds
                for c in ("keyboard_intensity_avg", "mouse_intensity_avg", "mic_active_ratio", "camera_active_ratio", "max_audio_volume", "mean_cpu_usage", "mean_ram_usage", "multitasking_score", "activity_score"):
                    d[c] = rng.choice([0.0, 0.25, 0.25 + rng.random() / 50])
                d |= {"total_copy_events": 3, "total_paste_events": rng.choice([0, 10])}
            rows.append(d)
    return spark.createDataFrame(rows).repartition(3).persist()


@pytest.mark.parametrize(("eps", "side", "steady"), [(0.3, 1024, 0.7), (0.3, 3, 0.5), (0.38, 7, 0.4), (0.2, 1024, 0.95)])
def test_clusters_equal_the_components_of_all_pairs(spark, eps, side, steady):
    df = made(spark, random.Random(side), {1: 110, 2: 40, 3: 1, 4: 60}, 40_000, steady)
    links, want = by_all_pairs(df, eps)
    got = density.cluster_all(df, ["user_id"], eps, side)
    assert got.columns == [*df.drop("cluster").columns, "cluster"]
    rows = got.collect()
    assert len(rows) == df.count() and links
    parts, expected = {}, {}
    for r in rows:
        parts.setdefault((r["user_id"], r["cluster"]), set()).add(r["segment_no"])
        expected.setdefault((r["user_id"], want(r["user_id"], r["segment_no"])), set()).add(r["segment_no"])
    as_sets = lambda held: sorted((u, sorted(s)) for (u, _), s in held.items())
    assert as_sets(parts) == as_sets(expected)
    starts = {(r["user_id"], r["segment_no"]): (r["start_time"], r["segment_no"]) for r in rows}
    for user in (1, 2, 3, 4):
        order = sorted((min(starts[user, n] for n in held), c) for (u, c), held in parts.items() if u == user)
        assert [c for _, c in order] == list(range(len(order)))


def test_edges_of_density(spark):
    df = made(spark, random.Random(1), {1: 3}, 100, 0.5)
    assert density.cluster_all(df.limit(0), ["user_id"]).count() == 0
    with pytest.raises(ValueError):
        density.cluster_all(df, ["user_id"], 0.4)
    one = df.limit(1)
    far = one.union(one.withColumns({"start_time": F.col("start_time") + timedelta(days=9), "end_time": F.col("end_time") + timedelta(days=9), "segment_no": F.col("segment_no") + 50}))
    assert T0 and density.cluster_all(far.fillna("Report draft", ["primary_window_title"]).fillna("code.exe", ["primary_app"]), ["user_id"]).select("cluster").distinct().count() == 1


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_small_squares_are_compared_together(monkeypatch, pairs):
    rng, n = np.random.default_rng(pairs), 300
    monkeypatch.setattr(density, "PAIRS", pairs)

    def side(first, most):
        squares = np.repeat(np.arange(n), rng.integers(0, most, n))
        rng.shuffle(squares)
        at = rng.random((len(squares), len(density.WEIGHTS)))
        names = [f"{s} {s + 1} 0 0" for s in squares]
        return pd.DataFrame({"square": names, "budget": 0.05 + squares / 1e4, "node": np.arange(len(squares)) + first, "gpu": rng.random(len(squares)) < 0.5, "at": list(at)})

    x, y = side(0, 4), side(10_000, 5)
    full, bare = (np.array([w[k] for w in density.WEIGHTS.values()]) for k in (0, 1))
    apart = {(a.node, b.node): (abs(a.at - b.at) * (full if a.gpu and b.gpu else bare)).sum() for a in x.itertuples() for b in y.itertuples() if a.square == b.square}
    calls, merged = [], density.merged
    monkeypatch.setattr(density, "merged", lambda *a: calls.append(1) or merged(*a))
    got = density._forest(x, y)
    budget = dict(zip(x.node, x.budget))
    links = [p for p, d in apart.items() if d <= budget[p[0]] - density.SLACK]
    parts = lambda u, v: dict(zip(*merged(np.array(u), np.array(v), range(len(u)))[1:]))
    assert links and parts(got["u"], got["v"]) == parts(*zip(*links))
    assert pairs < 1 << 18 or len(calls) == 1  # not one pass for each square
    best = {}
    for (u, v), d in apart.items():
        s = x.square[x.node == u].iloc[0]
        best[s] = min(best.get(s, (9, 0, 0)), (d, u, v))
    found = {f"{r.x} {r.y} 0 0": (r.u, r.v) for r in density._nearest(x, y).itertuples()}
    assert found == {s: (u, v) for s, (_, u, v) in best.items()}
