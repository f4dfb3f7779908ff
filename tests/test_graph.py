import random

import numpy as np
import pytest

from clanmark.operators import components as C
from clanmark.operators.density import dbscan
from clanmark.operators import linkage as L
from clanmark.operators.linkage import agglomerative_average, average_merge
from clanmark.operators import matching
from clanmark.operators.matching import greedy_matching, merge_pairs_greedy
from tests import samples as X


def edge_frame(spark, edges, parts=4):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long").repartition(parts)


def found_components(spark, n, edges):
    vertices = spark.range(n).withColumnRenamed("id", "v")
    rows = C.connected_components(edge_frame(spark, edges), vertices, "v").collect()
    return [c for _, c in sorted((r.v, r.component) for r in rows)]


@pytest.mark.parametrize("chunk", [500_000, 3])
def test_components_of_path_star_and_random_graphs(spark, monkeypatch, chunk):
    """With tiny chunks the contraction cannot finish alone and the star steps do the work."""
    monkeypatch.setattr(C, "CONTRACT_ROWS", chunk)
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(60)]
    star = [(70, 71 + i) for i in range(40)]
    scattered = [(rng.randrange(120, 220), rng.randrange(120, 220)) for _ in range(70)]
    edges = path + star + scattered
    rng.shuffle(edges)
    assert found_components(spark, 230, edges) == X.components(230, edges)


def test_star_steps_alone_reach_the_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    df = edge_frame(spark, [(max(e), min(e)) for e in edges if e[0] != e[1]])
    for _ in range(12):
        if C._is_star(df):
            break
        df = spark.createDataFrame(C._small_star(C._large_star(df)).collect(), "a long, b long")
    low = {r.a: r.b for r in df.collect()}
    assert [low.get(i, i) for i in range(80)] == X.components(80, edges)


def test_similarity_components_do_not_depend_on_row_order_and_refine(spark):
    matrix, _ = X.planted(seed=11)
    rows = {}
    for threshold in (0.75, 0.85):
        got = C.similarity_components(X.frame(spark, matrix), "id", "v", threshold).collect()
        rows[threshold] = [c for _, c in sorted((r.id, r.component) for r in got)]
        assert rows[threshold] == X.components(len(matrix), X.pairs_over(X.cosines(matrix), threshold))
    order = np.random.default_rng(1).permutation(len(matrix))
    shuffled = spark.createDataFrame(
        [(int(i), [float(x) for x in matrix[i]]) for i in order], "id long, v array<double>"
    )
    again = C.similarity_components(shuffled, "id", "v", 0.75, unit_rows_limit=20, pivots=5).collect()
    assert [c for _, c in sorted((r.id, r.component) for r in again)] == rows[0.75]
    coarse = {}
    for i, c in enumerate(rows[0.85]):
        assert coarse.setdefault(c, rows[0.75][i]) == rows[0.75][i]  # a higher threshold refines
    assert len(set(rows[0.85])) > len(set(rows[0.75])) > 1


def test_one_row_and_empty_input(spark):
    one = spark.createDataFrame([(4, [1.0, 0.0])], "id long, v array<double>")
    assert [(r.id, r.component) for r in C.similarity_components(one, "id", "v").collect()] == [(4, 4)]
    assert C.similarity_components(one.where("id < 0"), "id", "v").count() == 0


@pytest.mark.parametrize("limit", [50_000, 2])
def test_greedy_matching_equals_the_scan(spark, limit):
    """A limit of two edges sends nearly every component through the distributed rounds."""
    rng = random.Random(limit)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}
    edges |= {(100 + i, 101 + i) for i in range(9)}  # an ascending chain
    found = greedy_matching(edge_frame(spark, edges), limit).collect()
    assert sorted((r.a, r.b) for r in found) == X.greedy(edges)
    assert len(found) > 10


@pytest.mark.parametrize("seed", range(4))
def test_large_components_of_all_shapes(spark, seed):
    """Random graphs, cliques, stars, chains up and down, all too large to be scanned at once."""
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range((40, 80, 200, 500)[seed])}
    edges |= {(100 + i, 100 + j) for i in range(14) for j in range(i + 1, 14)}  # a clique
    edges |= {(200, 200 + i) for i in range(1, 30)} | {(300 + i, 330) for i in range(30)}  # stars
    edges |= {(400 + i, 401 + i) for i in range(40)} | {(100, 200), (113, 300), (414, 414 + 50)}
    names = list(range(1000))
    if seed % 2:
        rng.shuffle(names)
    edges = {tuple(sorted((names[a], names[b]))) for a, b in edges}
    found = greedy_matching(edge_frame(spark, edges), 5 + 20 * seed).collect()
    assert sorted((r.a, r.b) for r in found) == X.greedy(edges)


def test_steps_of_long_chains_grow_by_a_constant(spark, monkeypatch):
    steps, tables = [], []
    real = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, label="stage": tables.append(label) or real(df, label))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        for n in (100, 1000, 10_000):
            tables.clear()
            frame = spark.range(n).selectExpr("id AS a", "id + 1 AS b").repartition(3)
            found = greedy_matching(frame, 50)
            assert found.count() == n // 2 and found.where("a % 2 = 1").isEmpty()
            steps.append(len(tables))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert steps[2] - steps[1] <= steps[1] - steps[0] + 1 <= 8


def test_a_dense_component_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = matching.connected_components
    monkeypatch.setattr(matching, "connected_components", lambda *a: rounds.append(1) or real(*a))
    edges = {(i, j) for i in range(90) for j in range(i + 1, 90)}
    found = greedy_matching(edge_frame(spark, edges), 700).collect()
    assert sorted((r.a, r.b) for r in found) == X.greedy(edges) and len(rounds) <= 4


def test_chain_leaves_the_third_cluster_alone(spark):
    found = greedy_matching(edge_frame(spark, [(1, 2), (2, 3)])).collect()
    assert [(r.a, r.b) for r in found] == [(1, 2)]


def test_merge_joins_at_most_two_clusters(spark):
    matrix, _ = X.planted(seed=4, noise=0.5, hot=10)
    df = X.frame(spark, matrix)
    members = df.join(C.similarity_components(df, "id", "v", 0.85), "id")
    merged = merge_pairs_greedy(members, "component", "v", 0.7)
    per_target = {}
    for r in merged.collect():
        per_target.setdefault(r.merged, set()).add(r.component)
    sizes = [len(v) for v in per_target.values()]
    assert max(sizes) == 2 and min(sizes) == 1
    assert all(target == min(parts) for target, parts in per_target.items())


@pytest.mark.parametrize("min_samples", [1, 2, 3, 5])
def test_dbscan_equals_brute_force(spark, min_samples):
    matrix, _ = X.planted(seed=6, noise=0.75, hot=8)
    rows = dbscan(X.frame(spark, matrix), "id", "v", 0.25, min_samples).collect()
    got = {r.id: r.cluster for r in rows}
    expected = X.dbscan(matrix, 0.75, min_samples)
    assert [got[i] for i in range(len(matrix))] == expected
    assert min_samples == 1 or (None in expected and len(set(expected)) > 3)


def test_dbscan_of_two_is_components_without_singletons_and_euclidean_bound(spark):
    matrix, _ = X.planted(seed=9, hot=5)
    df = X.frame(spark, X.unit(matrix))
    got = {r.id: r.cluster for r in dbscan(df, "id", "v", 0.5, 2, "euclidean").collect()}
    assert [got[i] for i in range(len(matrix))] == X.dbscan(matrix, 0.875, 2)
    with pytest.raises(ValueError):
        dbscan(df, "id", "v", metric="manhattan")


@pytest.mark.parametrize("component_rows", [2000, 4])
@pytest.mark.parametrize("limit", [0.12, 0.4])
def test_average_linkage_equals_the_textbook(spark, component_rows, limit):
    """``component_rows`` of 4 sends every larger component through the distributed rounds."""
    matrix, _ = X.planted(seed=2, rows=70, noise=0.5, hot=6, hot_noise=0.1)
    rows = agglomerative_average(X.frame(spark, matrix), "id", "v", limit, component_rows).collect()
    got = [c for _, c in sorted((r.id, r.cluster) for r in rows)]
    expected = X.average_linkage(matrix, limit)
    assert got == expected and 1 < len(set(expected)) < len(matrix)


@pytest.mark.parametrize("options", [dict(unit_rows_limit=8, pivots=0), dict(unit_rows_limit=16, pivots=5)])
def test_average_linkage_rounds_over_several_units(spark, options):
    matrix, _ = X.planted(seed=5, rows=60, noise=0.5, hot=20, hot_noise=0.1)
    rows = agglomerative_average(X.frame(spark, matrix), "id", "v", 0.4, 3, **options).collect()
    assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == X.average_linkage(matrix, 0.4)


def test_average_linkage_keeps_unusable_rows(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>"
    )
    rows = agglomerative_average(df, "id", "v", 0.12).collect()
    assert sorted((r.id, r.cluster) for r in rows) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def textbook(matrix, limit):
    """One merge at a time: the most similar pair at 12 places, of equals the lowest one."""
    vectors = X.unit(matrix)
    clusters = [[i] for i in range(len(matrix))]
    while len(clusters) > 1:
        means = np.array([vectors[c].sum(0) / len(c) for c in clusters])
        sims = np.round(means @ means.T, 12)
        best = min((-sims[i, j], i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        if not 1.0 + best[0] < limit:
            break
        clusters[best[1]] = clusters[best[1]] + clusters.pop(best[2])
    label = {m: min(c) for c in clusters for m in c}
    return [label[i] for i in range(len(matrix))]


def test_average_linkage_with_ties_and_duplicates():
    for seed in range(50):
        matrix = np.random.default_rng(seed).integers(-2, 3, (24, 4)).astype(float)
        matrix[(matrix == 0).all(1)] = 1.0
        assert average_merge(X.unit(matrix), 0.15).tolist() == textbook(matrix, 0.15), seed


@pytest.mark.parametrize("seed", [0, 4])
def test_average_linkage_is_the_same_in_tasks_and_rounds(spark, seed):
    matrix = np.random.default_rng(seed).integers(-2, 3, (24, 4)).astype(float)
    matrix[(matrix == 0).all(1)] = 1.0
    df = X.frame(spark, matrix)
    want = textbook(matrix, 0.15)
    for component_rows in (1, 4, 2000):
        rows = agglomerative_average(df, "id", "v", 0.15, component_rows).collect()
        assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == want


def test_any_distance_limit(spark):
    matrix, _ = X.planted(seed=3, rows=40, noise=0.9, hot=4)
    df = X.frame(spark, matrix)
    got = {r.id: r.cluster for r in dbscan(df, "id", "v", 1.05, 2).collect()}
    assert [got[i] for i in range(len(matrix))] == X.dbscan(matrix, -0.05, 2)
    for limit in (1.0, 1.1):
        rows = agglomerative_average(df, "id", "v", limit, 5).collect()
        assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == textbook(matrix, limit)


def snowball(rows=400):
    """A cluster that takes in its neighbours one after the other, each at its own distance."""
    angles = np.concatenate([[0.0], 0.2 + 0.0009 * np.arange(rows)])
    side = np.random.default_rng(4).normal(size=(rows + 1, 30))
    return np.column_stack([np.cos(angles), np.sin(angles)[:, None] * X.unit(side)])


def test_last_clusters_are_finished_by_one_task(spark, monkeypatch):
    matrix = snowball()
    rounds = []
    nearest = L._nearest
    monkeypatch.setattr(L, "_nearest", lambda *a: rounds.append(1) or nearest(*a))
    rows = agglomerative_average(X.frame(spark, matrix), "id", "v", 0.2, 200).collect()
    assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == average_merge(X.unit(matrix), 0.2).tolist()
    assert len(rounds) == 1


@pytest.mark.parametrize("seed", range(4))
def test_merged_clusters_as_by_the_matrix(seed):
    rng = np.random.default_rng(seed)
    matrix = X.unit(np.concatenate([rng.normal(size=(150, 5)), snowball(80)[:, :5], np.repeat(rng.normal(size=(4, 5)), 3, axis=0)]))
    for limit in (0.05, 0.3, 0.6):
        ones = np.ones(len(matrix))
        assert L.merge_clusters(matrix, ones, limit).tolist() == average_merge(matrix, limit).tolist()


@pytest.mark.parametrize("unit", [16, 60])
def test_few_rounds_where_a_unit_holds_what_is_left(spark, monkeypatch, unit):
    """Clusters that take in their neighbours one by one: rounds over the table end where the rest fits a unit."""
    matrix = np.concatenate([snowball(40), X.planted(seed=7, rows=40, dim=31, hot=0)[0]])
    rounds = []
    nearest = L._nearest
    monkeypatch.setattr(L, "_nearest", lambda *a: rounds.append(a[0].count()) or nearest(*a))
    rows = agglomerative_average(X.frame(spark, matrix), "id", "v", 0.2, 2, unit_rows_limit=unit, pivots=3).collect()
    assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == average_merge(X.unit(matrix), 0.2).tolist()
    assert rounds == [0] if unit == 60 else 1 < len(rounds) < 8 and 40 < rounds[0]


def test_components_stay_whole_where_spark_changes_the_join(spark):
    """Joins that Spark turns into others when they run leave every component in one task."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    rng = np.random.default_rng(6)
    matrix = X.unit(np.repeat(rng.normal(size=(60, 64)), 10, axis=0)) + rng.normal(scale=0.045, size=(600, 64))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = agglomerative_average(X.frame(spark, matrix), "id", "v", 0.12, 2, unit_rows_limit=100, pivots=3).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    expected = average_merge(X.unit(matrix), 0.12).tolist()
    assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == expected and 60 < len(set(expected)) < 400
