"""The set-similarity join against all pairs, with hot items split, and that few pairs are made."""

from __future__ import annotations

import random

import pytest

from quillmill.operators import setjoin

KIND = "id long, items array<string>"


def planted(seed, many):
    """Sets with a few items that almost all hold, and edited copies."""
    r = random.Random(seed)
    out = []
    for k in range(many):
        if out and r.random() < 0.5:
            own = set(r.choice(out))
            own -= set(r.sample(sorted(own), min(len(own), r.randint(0, 2))))
            own |= set(r.sample([f"i{x}" for x in range(80)], r.randint(0, 2)))
        else:
            own = set(r.sample([f"i{x}" for x in range(80)], r.randint(1, 9)))
        out.append(own | ({"hot", "warm"} if k % 3 else {"hot"}) if k % 11 else own)
    return out


def brute(x, y, least, measure):
    out = {}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            shared, whole = len(a & b), len(a) if measure == "containment" else len(a | b)
            if whole and shared / whole >= least - 1e-12:
                out[i, j] = (shared, len(a), len(b), round(shared / whole, 9))
    return out


@pytest.mark.parametrize("measure", ["jaccard", "containment"])
@pytest.mark.parametrize(("least", "tile"), [(0.3, 20_000), (0.6, 7), (0.8, 20_000), (1.0, 7)])
def test_all_pairs(spark, measure, least, tile):
    x, y = planted(1, 60), planted(2, 150)
    frames = [spark.createDataFrame([(i, [*s, *list(s)[:2]]) for i, s in enumerate(d)], KIND).repartition(3) for d in (x, y)]
    got = {(r.left_id, r.right_id): (r.shared, r.left_n, r.right_n, round(r.score, 9)) for r in setjoin.similar(*frames, least, measure, tile).collect()}
    assert got == brute(x, y, least, measure) and got


def test_an_item_that_all_hold_makes_no_pairs(spark, monkeypatch):
    """Sets that share nothing else are not even candidates."""
    made = []
    keep = setjoin.io.written
    monkeypatch.setattr(setjoin.io, "written", lambda df, name: made.append((name, out := keep(df, name))) or out)
    rows = [(i, ["hot", *[f"x{i}_{k}" for k in range(9)]]) for i in range(300)]
    frame = spark.createDataFrame(rows, KIND)
    found = setjoin.similar(frame, frame, 0.7)
    assert found.count() == 300
    assert dict(made)["pairs"].count() == 300


def test_odd_sets(spark):
    x = spark.createDataFrame([(1, None), (2, []), (3, [None]), (None, ["a"]), (4, ["a", None, "a"])], KIND)
    y = spark.createDataFrame([(7, ["a"]), (8, []), (9, None)], KIND)
    got = [tuple(r) for r in setjoin.similar(x, y, 0.5).collect()]
    assert got == [(4, 7, 1, 1, 1, 1.0)]
    assert setjoin.similar(x.limit(0), y, 0.5).collect() == [] and setjoin.similar(x, y.limit(0), 0.5, "containment").collect() == []
    with pytest.raises(ValueError, match="least"):
        setjoin.similar(x, y, 0)
