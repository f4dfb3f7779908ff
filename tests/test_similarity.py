import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clanmark.operators import similarity as S
from tests import samples as X

LAYOUTS = [
    {},
    dict(unit_rows_limit=32, pivots=0),
    dict(unit_rows_limit=16, pivots=7),
    dict(unit_rows_limit=400, pivots=9),
]


@pytest.fixture(scope="module")
def data(spark):
    matrix, base = X.planted()
    return matrix, base, X.frame(spark, matrix).cache()


@pytest.fixture(scope="module")
def centres(spark, data):
    rows = [(f"u{i:03d}", [float(x) for x in v]) for i, v in enumerate(data[1])]
    return spark.createDataFrame(rows, "uid string, c array<double>").cache()


@pytest.mark.parametrize("options", LAYOUTS)
def test_self_join_equals_brute_force(data, options):
    matrix, _, df = data
    sims = X.cosines(matrix)
    rows = S.similarity_self_join(df, "id", "v", 0.75, **options).collect()
    expected = X.pairs_over(sims, 0.75)
    assert len(expected) > 1000
    assert len(rows) == len(expected) and {(r.a, r.b) for r in rows} == expected
    assert max(abs(r.similarity - sims[r.a, r.b]) for r in rows) < 1e-9


@pytest.mark.parametrize("options", LAYOUTS)
def test_neighbour_counts(data, options):
    matrix, _, df = data
    degree = (X.cosines(matrix) >= 0.8).sum(axis=1) - 1
    found = {r.id: r.n for r in S.neighbour_counts(df, "id", "v", 0.8, **options).collect()}
    assert [found.get(i, 0) for i in range(len(matrix))] == list(degree)


@pytest.mark.parametrize("options", LAYOUTS)
@pytest.mark.parametrize("threshold", [0.6, 0.9, 0.999])
def test_forest_connects_what_the_graph_connects(data, options, threshold):
    matrix, _, df = data
    edges = [(r.a, r.b) for r in S.similarity_forest(df, "id", "v", threshold, **options).collect()]
    expected = X.components(len(matrix), X.pairs_over(X.cosines(matrix), threshold))
    assert X.components(len(matrix), edges) == expected


def test_hot_group_costs_one_edge_per_row(spark):
    matrix, _ = X.planted(rows=60, hot=600)
    df = X.frame(spark, matrix)
    _, layout, spread = S._one_table(df, "id", "v", 0.75, forest=True, unit_rows_limit=100, pivots=8)
    assert layout.only_core(np.flatnonzero(layout.home_rows >= 500)).all()
    assert spread.count() < 60 * 60  # the 600 near copies are not compared with each other
    edges = S.similarity_forest(df, "id", "v", 0.75, unit_rows_limit=100, pivots=8)
    assert edges.count() < 3 * len(matrix)


def test_a_second_level_of_pivots(spark, monkeypatch):
    """A few pivots for many groups: copies of a row stay as few when rows and groups grow 4 and 16 times."""
    monkeypatch.setattr(S, "MAX_PIVOTS", 6)
    copies = {True: [], False: []}
    for groups in (8, 32, 128):
        rng = np.random.default_rng(groups)
        base = X.unit(rng.normal(size=(groups, 24)))
        matrix = np.repeat(base, 80, axis=0) + rng.normal(scale=0.03, size=(80 * groups, 24))
        df = X.frame(spark, matrix).repartition(4)
        for finer in (True, False):
            monkeypatch.setattr(S, "FEW_UNITS", 4 if finer else 1 << 40)
            _, layout, spread = S._one_table(df, "id", "v", 0.75, unit_rows_limit=40)
            assert (layout.parents is not None) == (finer and groups > 8)
            copies[finer].append(spread.count() / len(matrix))
            print(groups, finer, copies[finer][-1], None if layout.pivots is None else len(layout.pivots))
        if groups == 80:
            monkeypatch.setattr(S, "FEW_UNITS", 4)
            found = {(r.a, r.b) for r in S.similarity_self_join(df, "id", "v", 0.75, unit_rows_limit=40).collect()}
            assert found == {(int(i), int(j)) for i, j in X.pairs_over(X.cosines(matrix), 0.75)}
            edges = [(r.a, r.b) for r in S.similarity_forest(df, "id", "v", 0.75, unit_rows_limit=40).collect()]
            assert X.components(len(matrix), edges) == X.components(len(matrix), found)
            half = df.where("id % 2 = 0").select(F.col("id").alias("i"), F.col("v").alias("w"))
            top = S.top_matches(half, df, "i", "w", "id", "v", 2, broadcast_bytes=0, unit_rows_limit=40).collect()
            sims = np.round(X.cosines(matrix), 12)
            want = {(i, int(j)) for i in range(0, len(matrix), 2) for j in np.argsort(-sims[i], kind="stable")[:2]}
            assert {(r.a, r.b) for r in top} == want
    assert copies[True][2] < 2 * copies[True][1] and copies[True][2] < copies[False][2] / 2


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(
    "options", [{}, *[dict(broadcast_bytes=0, **layout) for layout in LAYOUTS[1:]], dict(broadcast_bytes=0)]
)
def test_cross_join(data, centres, options, strict):
    matrix, base, df = data
    sims = X.cosines(matrix, base)
    rows = S.similarity_cross_join(df, centres, "id", "v", "uid", "c", 0.5, strict, **options).collect()
    expected = {(int(i), f"u{j:03d}") for i, j in zip(*np.nonzero(sims >= 0.5))}
    assert expected and len(rows) == len(expected) and {(r.a, r.b) for r in rows} == expected


@pytest.mark.parametrize("threshold", [None, 0.65])
@pytest.mark.parametrize(
    "options",
    [{}, dict(broadcast_bytes=0), dict(broadcast_bytes=0, unit_rows_limit=4, pivots=5),
     dict(broadcast_bytes=0, unit_rows_limit=4, pivots=0)],
)
def test_argmax_match(data, centres, options, threshold):
    matrix, base, df = data
    sims = X.cosines(matrix, base)
    rows = S.argmax_match(df, centres, "id", "v", "uid", "c", threshold, **options).collect()
    expected = {
        i: f"u{sims[i].argmax():03d}" for i in range(len(matrix)) if threshold is None or sims[i].max() >= threshold
    }
    assert len(rows) == len(expected) and {r.a: r.b for r in rows} == expected


@pytest.mark.parametrize(
    "options",
    [{}, dict(broadcast_bytes=0), dict(broadcast_bytes=0, unit_rows_limit=16, pivots=6),
     dict(broadcast_bytes=0, unit_rows_limit=40, pivots=0)],
)
def test_knn(data, centres, options):
    matrix, base, df = data
    order = np.argsort(-X.cosines(base, matrix), axis=1, kind="stable")[:, :5]
    rows = S.knn_search(centres, df, "uid", "c", "id", "v", 5, **options).collect()
    found = {(r["query"], r["rank"]): r["neighbour"] for r in rows}
    assert len(rows) == 5 * len(base)
    assert all(found[f"u{q:03d}", k + 1] == order[q, k] for q in range(len(base)) for k in range(5))


def unit_table(matrix, sides):
    """What a unit kernel receives: all rows of one chunk, or two sides of a chunk pair."""
    n, own = len(matrix), sides is None
    side = np.zeros(n, dtype=np.int64) if own else np.asarray(sides)
    zeros, right = np.zeros(n, dtype=np.int64), np.full(n, 0 if own else 1)
    columns = [pa.array(c) for c in (zeros, zeros, right, side, np.arange(n))]
    return pa.table([*columns, S.list_array(X.unit(matrix))], names=["cell", "left", "right", "side", "id", "unit"])


@pytest.mark.parametrize("two_sides", [False, True])
def test_kernels_work_slice_by_slice(monkeypatch, two_sides):
    monkeypatch.setattr(S, "SCRATCH_ELEMENTS", 1)
    matrix, _ = X.planted(seed=13, groups=40, rows=500, hot=300)
    n = len(matrix)
    sides = np.arange(n) % 2 if two_sides else None
    sims = X.cosines(matrix)
    expected = {(i, j) for i, j in X.pairs_over(sims, 0.8) if not two_sides or sides[i] != sides[j]}
    table = unit_table(matrix, sides)
    pairs = pa.Table.from_batches(S._pairs_kernel(0.8, False, True)(iter(table.to_batches()))).to_pydict()
    assert set(zip(pairs["a"], pairs["b"])) == expected and len(pairs["a"]) == len(expected)
    forest = S._forest_kernel(0.8)(table).to_pydict()
    assert len(forest["a"]) < n
    assert X.components(n, list(zip(forest["a"], forest["b"]))) == X.components(n, expected)
    counts = S._degree_kernel(0.8, False)(table).to_pydict()
    degree = np.bincount(np.array(list(expected)).ravel(), minlength=n)
    assert dict(zip(counts["id"], counts["n"])) == {i: d for i, d in enumerate(degree) if d}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_of_ranks_ties_by_position(monkeypatch, k):
    monkeypatch.setattr(S, "SCRATCH_ELEMENTS", 1)
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 3, (20, 4)).astype(float), rng.integers(0, 3, (30, 4)).astype(float)
    rows, columns, values = S.top_of(left, right, k)
    want = np.argsort(-(left @ right.T), axis=1, kind="stable")[:, :k]
    assert (columns.reshape(20, -1) == want).all() and (rows.reshape(20, -1) == np.arange(20)[:, None]).all()


def test_ties_go_to_the_lower_id(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    right = spark.createDataFrame(
        [("b", [2.0, 0.0]), ("a", [5.0, 0.0]), ("c", [1.0, 0.1])], "uid string, c array<double>"
    )
    for options in ({}, dict(broadcast_bytes=0)):
        row = S.argmax_match(left, right, "id", "v", "uid", "c", **options).collect()
        assert [(r.a, r.b) for r in row] == [(1, "a")]


def test_exact_threshold_and_unusable_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [0.75, float(np.sqrt(0.4375))]),
        (2, [0.0, 0.0]),
        (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]),
        (5, None),
        (6, []),
    ]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.a, r.b) for r in S.similarity_self_join(df, "id", "v", 0.75).collect()] == [(0, 1)]
    assert S.similarity_self_join(df, "id", "v", 0.75, strict=True).count() == 0
    with pytest.raises(ValueError):
        S.similarity_self_join(df, "id", "v", 1.5)


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, v array<double>")
    for df in (empty, one):
        assert S.similarity_self_join(df, "id", "v").count() == 0
        assert S.similarity_forest(df, "id", "v", 0.75).count() == 0
    assert S.argmax_match(one, empty.withColumnsRenamed({"id": "k", "v": "w"}), "id", "v", "k", "w").count() == 0


def test_string_ids(spark):
    matrix, _ = X.planted(rows=40, hot=10)
    rows = [(f"d{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    expected = {(f"d{i:03d}", f"d{j:03d}") for i, j in X.pairs_over(X.cosines(matrix), 0.75)}
    for options in LAYOUTS[:3]:
        found = S.similarity_self_join(df, "id", "v", 0.75, **options).collect()
        assert {(r.a, r.b) for r in found} == expected


@pytest.mark.parametrize("options", [dict(unit_rows_limit=16, pivots=8), dict(unit_rows_limit=32)])
def test_copies_of_a_row_do_not_grow_with_the_table(spark, options):
    """Rows without structure, which no pivot prunes: small units given for a small table are few in a large one too."""
    copies = []
    for rows in (1000, 4000):
        matrix = X.unit(np.random.default_rng(rows).normal(size=(rows, 32)))
        matrix[rows // 2 :] = X.unit(matrix[: rows // 2] + np.random.default_rng(1).normal(scale=0.08, size=(rows // 2, 32)))
        df = X.frame(spark, matrix)
        copies.append(S._one_table(df, "id", "v", 0.75, **options)[2].count() / rows)
        found = S.similarity_self_join(df, "id", "v", 0.75, **options).collect()
        expected = X.pairs_over(X.cosines(matrix), 0.75)
        assert len(expected) > rows / 4 and len(found) == len(expected) and {(r.a, r.b) for r in found} == expected
    assert copies[1] < 1.5 * copies[0] and copies[1] < 3 * S.MOST_CHUNKS


def test_rows_that_would_visit_most_cells_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "MIN_UNIT_ROWS", 32)
    noise = X.unit(np.random.default_rng(5).normal(size=(1200, 32)))
    noise[600:] = X.unit(noise[:600] + np.random.default_rng(1).normal(scale=0.08, size=(600, 32)))
    df = X.frame(spark, noise)
    _, layout, spread = S._one_table(df, "id", "v", 0.75)
    assert layout.pivots is None and spread.count() <= 6 * len(noise)  # 21 units for 8 cores
    expected = X.pairs_over(X.cosines(noise), 0.75)
    found = S.similarity_self_join(df, "id", "v", 0.75).collect()
    assert len(expected) > 300 and len(found) == len(expected) and {(r.a, r.b) for r in found} == expected
    edges = [(r.a, r.b) for r in S.similarity_forest(df, "id", "v", 0.75).collect()]
    assert X.components(len(noise), edges) == X.components(len(noise), expected)
    groups = np.repeat(X.unit(np.random.default_rng(6).normal(size=(12, 32))), 100, axis=0)
    apart = X.frame(spark, groups + np.random.default_rng(7).normal(scale=0.03, size=groups.shape))
    layout = S._one_table(apart, "id", "v", 0.75)[1]
    assert layout.pivots is not None
    monkeypatch.setattr(S, "CHUNK_BYTES", 100 * 8 * 32)
    assert S._chunked(df, layout, 1200).home_chunks().tolist() == [12]
