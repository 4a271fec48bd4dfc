"""Hard negatives against plain Python, and the bounds against true angles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, Label2 string, at long, norm string, block string, targets string"


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    ok = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        ok.append((i, [int(np.floor(scale * float(np.float32(c)))) for c in x], label))
    out = []
    for i, a, label in ok:
        if not anchor(i):
            continue
        scored = [(sum(p * q for p, q in zip(a, x)), j, other) for j, x, other in ok if j != i]
        near = sorted(((-s, j) for s, j, other in scored if other == label))[:positives]
        for s, p in near:
            found = sorted((-t, j) for t, j, other in scored if other != label and -low * s <= 100 * t <= -high * s)[:negatives]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(found, 1)]
    return sorted(out)


def table(seed, n=400, d=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 5)) if rng.random() < 0.7 else 0  # one label holds much of the table
        x = centres[int(rng.integers(0, 5))] * rng.uniform(0.2, 1.5) + rng.normal(size=d) * 0.4
        rows.append((i, x.astype(np.float32).tolist(), label))
    rows += [(n + k, rows[3][1], k % 2) for k in range(6)]  # equal vectors: ties
    rows += [(5, rows[8][1], 1), (40, rows[9][1], 2), (40, rows[9][1], 2)]  # repeated ids, one an anchor's
    rows += [(700, None, 1), (701, [1.0, None] + [0.0] * (d - 2), 1), (702, [float("nan")] * d, 1), (703, [float("inf")] * d, 0)]
    rows += [(704, rows[0][1], None), (None, rows[0][1], 1), (720, [0.0] * d, 1), (740, [0.5, 0.25], 1), (741, [], 2)]
    return rows


def ask(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "n", "b", "t") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 20 == 0, **options).collect())


@pytest.mark.parametrize("sizes", [(8_192, 256, 64), (32, 4, 5)])
def test_against_plain_python(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "GROUP_ROWS", "WINDOW_ROWS"), sizes):
        monkeypatch.setattr(H, name, value)
    rows = table(3)
    want = plain(rows, lambda i: i % 20 == 0)
    assert want and ask(spark, rows) == want


def test_other_numbers_of_rows_and_scores(spark):
    rows = table(4, n=150)
    assert ask(spark, rows, positives=2, negatives=3, low=80, high=99, scale=64) == plain(rows, lambda i: i % 20 == 0, 2, 3, 80, 99, 64)


def test_scores_beyond_exact_doubles_are_whole_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 2.0**20).astype(np.float32).tolist(), i % 3) for i in range(90)]
    got = ask(spark, rows, scale=256)
    assert got == plain(rows, lambda i: i % 20 == 0) and got


def test_no_rows_no_anchors_and_one_label(spark):
    assert ask(spark, []) == []
    assert ask(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == []
    assert ask(spark, [(20, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 500, 300)[:, None]
    x[5], x[6], x[7] = 0, x[8], -x[8]
    directions = H.reference_directions(x, 6)
    norms, units = H._unit(x)
    angles = np.arccos(np.clip(units @ directions.T, -1, 1))
    starts = np.arange(0, 300, 7)
    cut = lambda f, v: f.reduceat(v, starts, axis=0)
    lower, upper = H.score_bounds(
        angles, norms, cut(np.minimum, angles), cut(np.maximum, angles), cut(np.minimum, norms), cut(np.maximum, norms), H.angle_margin(12)
    )
    scores = x @ x.T
    assert (cut(np.minimum, scores.T).T >= lower).all() and (cut(np.maximum, scores.T).T <= upper).all()
    tight = upper - lower < 2 * norms[:, None] * cut(np.maximum, norms)
    assert tight.any()


def test_windows_out_of_reach_are_not_scored(spark):
    """A tight cluster asked about: windows of far clusters fall by their bounds."""
    rng = np.random.default_rng(9)
    centres = np.eye(8) * 100
    x = np.concatenate([c + rng.normal(size=(64, 8)) for c in centres])
    norms, units = H._unit(x)
    directions = H.reference_directions(x, 8)
    angles = np.arccos(np.clip(units @ directions.T, -1, 1))
    cut = lambda f, v: f.reduceat(v, np.arange(0, 512, 64), axis=0)
    _, upper = H.score_bounds(
        angles[:1], norms[:1], cut(np.minimum, angles), cut(np.maximum, angles), cut(np.minimum, norms), cut(np.maximum, norms), H.angle_margin(8)
    )
    assert (upper[0] >= 0.5 * 100 * 100).sum() == 1
