"""First-fit splits take few rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import ranking, splits


def test_first_fit_rounds_are_bounded(spark, monkeypatch):
    """A round ends at a group that does not fit, so what is left falls below that group's size. Sizes that
    fall by halves, each just too large for what is left, need one round each: as many as the logarithm."""
    sizes = [2**k + 1 for k in range(16, 0, -1)] + [1] * 40
    groups = spark.createDataFrame([(f"g{i}", s, i) for i, s in enumerate(sizes)], "_g string, size long, at long")
    rounds, summed = [], splits.running_total

    def counted(*args, **kwargs):
        rounds.append(1)
        return summed(*args, **kwargs)

    monkeypatch.setattr(splits, "running_total", counted)
    goal = 2**16 + 20
    taken, filled = splits.first_fit(groups, goal)
    want, left = set(), goal
    for i, s in enumerate(sizes):
        if s <= left or i == 0:
            want.add(f"g{i}")
            left -= s
    assert {r["_g"] for r in taken.collect()} == want and filled == goal - left and len(rounds) <= 18


def test_checkpoint_folder_is_the_sessions(spark):
    folder = ranking.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert ranking.kept(spark.range(3).select(F.col("id") * 2)).count() == 3


def test_search_is_near_a_greedy_one(spark):
    """Of 60 assignments each, the best by running sums against the best that gives every group to the part that lacks most."""
    import numpy as np

    from kinweave.operators import feasibility

    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 30, 150), [200, 120, 90]])
    rows = [(f"g{i}", int(rng.integers(0, 2))) for i, s in enumerate(sizes) for _ in range(s)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, label int")
    goal, best = np.array(feasibility.SHARES) * sizes.sum(), 1.0
    first = list(np.argsort(-sizes, kind="stable")[:3])
    rest = [i for i in range(len(sizes)) if i not in first]
    for _ in range(60):
        filled = np.zeros(3)
        for i in [*first, *rng.permutation(rest)]:
            filled[np.argmax(goal - filled)] += sizes[i]
        best = min(best, float(np.max(np.abs(filled - goal) / goal)))
    found = feasibility.search(df, "g", 60, 1).where("covered").agg(F.min("deviation")).first()[0]
    print(f"deviation {found:.4f}, greedy {best:.4f}")
    assert found <= best + 0.03
