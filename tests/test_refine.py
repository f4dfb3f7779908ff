import numpy as np
import pytest

from clanmark.operators import refine as R
from tests import samples as X


def labelled(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<double>, q double")


def as_map(df):
    return {r.id: r.label for r in df.collect()}


@pytest.fixture(scope="module")
def clusters(spark):
    """A pair near a group of four, a pair far away, a single near the group, and noise."""
    rows = [(i, 10, [1.0, 0.02 * i, 0.0], 0.9) for i in range(4)]
    rows += [(4, 20, [0.9, 0.4, 0.0], 0.9), (5, 20, [0.9, 0.45, 0.0], 0.9)]
    rows += [(6, 30, [0.0, 0.0, 1.0], 0.9), (7, 30, [0.0, 0.1, 1.0], 0.9)]
    rows += [(8, 40, [0.95, 0.3, 0.05], 0.2), (9, None, [1.0, 0.0, 0.0], 0.9)]
    return labelled(spark, rows)


def test_absorb_small(clusters):
    got = as_map(R.absorb_small(clusters, "id", "label", "v"))
    assert [got[i] for i in range(10)] == [10] * 4 + [10, 10, 30, 30, 10, None]


def test_absorb_small_is_strict(spark):
    exact = labelled(
        spark,
        [(i, 1, [1.0, 0.0], 1.0) for i in range(3)] + [(3, 2, [0.75, float(np.sqrt(0.4375))], 1.0)],
    )
    assert as_map(R.absorb_small(exact, "id", "label", "v", threshold=0.75))[3] == 2
    assert as_map(R.absorb_small(exact, "id", "label", "v", threshold=0.7499))[3] == 1


def test_absorb_singletons_may_choose_label_zero(spark):
    rows = [(0, 0, [1.0, 0.0], 1.0), (1, 0, [1.0, 0.1], 1.0), (2, 5, [1.0, 0.2], 1.0)]
    assert as_map(R.absorb_singletons(labelled(spark, rows), "id", "label", "v")) == {0: 0, 1: 0, 2: 0}


def test_absorb_small_quality_bonus_decides(spark):
    single = [0.68, float(np.sqrt(1 - 0.68**2))]
    for quality, expected in ((0.5, 1), (0.1, 2)):  # 0.68 + 0.05 > 0.7, 0.68 + 0.01 is not
        rows = [(0, 1, [1.0, 0.0], quality), (1, 1, [1.0, 0.0], quality), (2, 2, single, 0.9)]
        got = as_map(R.absorb_small_quality(labelled(spark, rows), "id", "label", "v", "q"))
        assert got == {0: 1, 1: 1, 2: expected}


def test_merge_components_and_force_merge(clusters):
    merged = as_map(R.merge_components(clusters, "id", "label", "v", 0.9))
    assert [merged[i] for i in range(10)] == [10] * 6 + [30, 30, 10, None]
    forced = as_map(R.force_merge(clusters, "id", "label", "v", 0.15))
    assert [forced[i] for i in range(10)] == [10] * 6 + [30, 30, 10, None]


def test_outliers_need_distance_and_low_quality(spark):
    rng = np.random.default_rng(0)
    body = [(i, 1, [1.0, 0.01 * float(rng.normal())], 0.9) for i in range(20)]
    for quality, expected in ((0.3, None), (0.7, 1), (None, 1)):
        rows = body + [(20, 1, [0.0, 1.0], quality), (21, 2, [0.0, 1.0], 0.1)]
        got = as_map(R.outliers_to_noise(labelled(spark, rows), "id", "label", "v", "q"))
        assert got[20] == expected and got[21] == 2 and all(got[i] == 1 for i in range(20))


def test_outliers_equal_numpy(spark):
    matrix, _ = X.planted(seed=7, rows=150, hot=30)
    rng = np.random.default_rng(2)
    labels, quality = rng.integers(0, 6, len(matrix)), rng.uniform(0, 1, len(matrix))
    rows = [(i, int(labels[i]), [float(x) for x in matrix[i]], float(quality[i])) for i in range(len(matrix))]
    got = as_map(R.outliers_to_noise(labelled(spark, rows), "id", "label", "v", "q", 0.6, 1.0))
    moved = 0
    for label in range(6):
        idx = np.flatnonzero(labels == label)
        d = 1 - matrix[idx] @ matrix[idx].mean(axis=0)
        out = (d > d.mean() + d.std()) & (quality[idx] < 0.6)
        moved += out.sum()
        assert [got[i] is None for i in idx] == list(out)
    assert moved > 5


def test_label_split_orders_by_size_then_first_member(clusters):
    split, noise = R.label_split(clusters, "id", "label")
    rows = sorted((r.cluster_id, r.label, r["size"]) for r in split.collect())
    assert rows == [("cluster_0", 10, 4), ("cluster_1", 20, 2), ("cluster_2", 30, 2), ("cluster_3", 40, 1)]
    assert [r.id for r in noise.collect()] == [9]
