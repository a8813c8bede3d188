"""Hard-negative mining against brute force, and the bounds of the walk."""

import math

import numpy as np
import pyarrow as pa
import pytest

from steerframe.llm import hard_negatives as hn

import oracle
from steerframe.llm import catalog


def by_brute_force(rows):
    """(anchor, positive rank, positive, rank, negative, scores) over plain Python integers."""
    good = []
    for vec_id, vec, label in rows:
        if None in (vec_id, vec, label) or not vec or not all(
            x is not None and math.isfinite(x) for x in vec
        ):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        good.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    anchors = {}
    for vec_id, label, vec in sorted(good):
        if vec_id % 100 == 0:
            anchors.setdefault(vec_id, (label, vec))
    out = []
    for anchor, (label, vec) in anchors.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(vec, v)), i, l)
            for i, l, v in good if i != anchor and len(v) == len(vec)
        )
        for p_score, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [
                (i, -s) for s, i, l in scored
                if l != label and 30 * -p_score <= 100 * -s <= 90 * -p_score
            ]
            out += [(anchor, p, r + 1, i, -p_score, s) for r, (i, s) in enumerate(fits[:10])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    x = centres[rng.integers(0, 12, 900)] + 0.2 * rng.standard_normal((900, 8))
    labels = rng.integers(0, 4, 900)
    out = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    out += [(900, None, 1), (1000, [1.0] * 8, None), (1100, [math.nan] * 8, 1), (None, [1.0] * 8, 1),
            (1200, [1.0, 2.0], 1), (1201, [1.0, 2.5], 1), (1202, [0.5, 1.0], 2), (1300, [], 1),
            (1400, [None] * 8, 1), (1500, [math.inf] * 8, 1), (1600, [0.0] * 8, 1)]
    out += [(2000 + i, x[7].tolist(), 2) for i in range(40)]  # ties
    out += [(100, x[100].tolist(), int(labels[100]))] * 2 + [(33, x[33].tolist(), 3)] * 3
    return out


SCHEMA = "vec_id long, embedding array<double>, label int, score string"


@pytest.mark.parametrize("sizes", [(3, 100), (8192, 16384)])
def test_mining_equals_brute_force(spark, rows, sizes):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    mined = hn.mine(hn.noisy_labels(df), anchor_rows=sizes[0], candidate_rows=sizes[1])
    got = sorted(
        (r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
        for r in mined.collect()
    )
    want = by_brute_force(rows)
    # a positive that occurs twice ranks its negatives twice, an id that does likewise
    assert len(want) > 200 and got == want
    assert hn.mine(hn.noisy_labels(df.limit(0))).count() == 0


def test_mining_of_the_corpus_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op12_hard_negatives"
    query, sql = catalog.QUERIES[name](spark, sf), catalog.ORACLES[name]
    assert oracle.differences(query, oracle.connect(sf), sql) is None


def test_large_components_are_exact(spark):
    big = 2.0**23
    data = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big, 3.0], 1), (3, [big * 0.5, 1.0], 2),
            (4, [big * 0.5, 2.0], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(
        (r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
        for r in hn.mine(hn.noisy_labels(df)).collect()
    )
    # 0 is divisible by 7, so its label turns into 2 and the rows of label 1 are its negatives
    assert got == by_brute_force(data)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(9)
    centres = 4000 * rng.standard_normal((6, 6))
    points = np.rint(centres[rng.integers(0, 6, 60)] + 40 * rng.standard_normal((60, 6))).astype(np.int64)
    tree = hn._tree_rows(pa.table({
        "anchor": np.zeros(60, np.int64), "size": pa.array([6] * 60, pa.int32()),
        "vec_id": np.arange(60), "label": np.zeros(60, np.int64),
        "vec": pa.array(points.tolist(), pa.list_(pa.int64())),
    }))
    cands = np.rint(centres[rng.integers(0, 6, 500)] + 40 * rng.standard_normal((500, 6))).astype(np.int64)
    walk = hn._Walk(tree, pa.table({"vec": pa.array(cands.tolist(), pa.list_(pa.int64()))}))
    true = hn._matrix(tree["vec"]) @ cands.T
    edge = true.max() * 0.9
    for nodes, low, high in walk.levels(lambda nodes, low, high: high >= edge):
        assert (low <= true[nodes]).all() and (true[nodes] <= high).all()
        exact = (true[nodes] >= edge)
        assert (low == high)[exact].all()
    assert walk.rescored < walk.met / 2
