import numpy as np
import pandas as pd
import pytest

from clearwell.functions import storage
from clearwell.operators import knn


def brute_force(pdf, k):
    """Every row against every other, one gap at a time."""
    data = pdf.to_numpy(dtype=float)
    out, width = data.copy(), data.shape[1]
    for i, row in enumerate(data):
        for f in np.flatnonzero(np.isnan(row)):
            donors = []
            for other in data:
                if np.isnan(other[f]):
                    continue
                shared = ~np.isnan(row) & ~np.isnan(other)
                if shared.any():
                    d = 0.0
                    for j in np.flatnonzero(shared):
                        d += (row[j] - other[j]) ** 2
                    donors.append((d * (width / shared.sum()), other[f]))
            donors.sort()
            values = [v for _, v in donors[:k]] or data[~np.isnan(data[:, f]), f]
            out[i, f] = np.mean(values)
    return out


def frame(spark, pdf):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))


def check(spark, pdf, k=5, **options):
    # Sums in another order differ in the last digits, which must not change the order of rows.
    rounded = lambda rows: np.array(sorted(tuple(round(v, 9) for v in r) for r in rows))
    got = knn.knn_impute(frame(spark, pdf), k, **options).collect()
    np.testing.assert_allclose(rounded(got), rounded(brute_force(pdf, k)), rtol=1e-9, atol=1e-8)


@pytest.fixture(scope="module")
def untidy():
    rng = np.random.default_rng(11)
    n = 400
    a = rng.normal(0, 100, n)
    pdf = pd.DataFrame({"a": a, "b": a / 10 + rng.normal(0, 5, n), "c": rng.integers(0, 6, n).astype(float)})
    for c, share in (("a", 0.1), ("b", 0.15), ("c", 0.1)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    pdf.loc[0] = np.nan  # nothing to compare by
    hot = pd.DataFrame({"a": [5.0] * 150, "b": [np.nan] * 150, "c": [2.0] * 150})
    donor = pd.DataFrame({"a": [5.0] * 150, "b": [0.25] * 150, "c": [2.0] * 150})
    return pd.concat([pdf, hot, donor], ignore_index=True)


def test_equals_brute_force(spark, untidy):
    check(spark, untidy)


def test_equals_brute_force_on_a_fine_grid(spark, untidy, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    check(spark, untidy, block_rows=16)


def test_equals_brute_force_without_boxes_and_broadcast(spark, untidy, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    check(spark, untidy.head(120), k=3, max_cells=3, broadcast_rows=0, block_rows=64)


def test_few_donors_and_void_column(spark):
    df = spark.createDataFrame(
        [(1.0, 10.0, None), (2.0, 20.0, None), (3.0, None, None)], "a double, b double, void double"
    )
    rows = sorted(knn.knn_impute(df).collect())
    assert rows[2]["b"] == 15.0 and rows[2]["void"] is None


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a bigint, t string")
    assert sorted(knn.knn_impute(df).collect()) == [(1.0, "x"), (2.0, "y")]


def test_routing_never_misses_a_neighbour():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(500, 3))
    cells = np.array_split(points[np.argsort(points[:, 0])], 25)
    low = np.array([c.min(axis=0) for c in cells])
    high = np.array([c.max(axis=0) for c in cells])
    copies = np.array([len(c) for c in cells])
    samples = np.concatenate([c[:4] for c in cells])
    searched = []
    for x in rng.normal(size=(50, 3)):
        x[2] = np.nan
        chosen = np.flatnonzero(knn._cells_to_search(x[None], low, high, copies, samples, 5)[0])
        d = [((c[:, :2] - x[:2]) ** 2).sum(axis=1) for c in cells]
        limit = np.sort(np.concatenate(d))[4]
        needed = {i for i, part in enumerate(d) if (part <= limit).any()}
        assert needed <= set(chosen)
        searched.append(len(chosen))
    assert np.mean(searched) < 18


def test_more_sets_of_missing_columns_than_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(0, 10, (150, 6)), columns=list("abcdef"))
    wide = wide.mask(rng.random(wide.shape) < 0.35)
    check(spark, wide, max_cells=8)
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    monkeypatch.setattr(knn, "CUT_FROM", 16)
    check(spark, wide, max_cells=8)


def test_column_names_of_the_search_itself(spark, untidy):
    named = untidy.head(120).rename(columns={"a": "y0", "b": "n", "c": "value"})
    got = knn.knn_impute(frame(spark, named))
    assert got.columns == ["y0", "n", "value"]
    check(spark, named)


@pytest.mark.parametrize("max_cells", [4, 16])
def test_overfull_cells_are_cut_again(spark, untidy, monkeypatch, max_cells):
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    monkeypatch.setattr(knn, "CUT_FROM", 16)
    check(spark, untidy, max_cells=max_cells)


def scattered(rows, columns, share, seed):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(0, 10, (rows, columns)), columns=[f"c{i}" for i in range(columns)])
    return wide.mask(rng.random(wide.shape) < share)


def fast_brute_force(pdf, k=5):
    """As ``brute_force`` for tables without ties, all gaps of a column at once."""
    data = pdf.to_numpy(dtype=float)
    out, width = data.copy(), data.shape[1]
    for i, row in enumerate(data):
        shared = ~np.isnan(row) & ~np.isnan(data)
        n = shared.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(shared, (data - row) ** 2, 0.0).sum(axis=1) * (width / n)
        for f in np.flatnonzero(np.isnan(row)):
            able = np.flatnonzero((n > 0) & ~np.isnan(data[:, f]))
            near = able[np.argsort(d[able], kind="stable")[:k]]
            out[i, f] = data[near, f].mean() if len(near) else np.nanmean(data[:, f])
    return out


def compare_scattered(spark, pdf, **options):
    report = {}
    got = np.array(sorted(map(tuple, knn.knn_impute(frame(spark, pdf), report=report, **options).collect())))
    np.testing.assert_allclose(got, np.array(sorted(map(tuple, fast_brute_force(pdf)))), rtol=1e-9)
    return report


@pytest.mark.parametrize("columns, share", [(6, 0.35), (14, 0.35), (3, 0.6)])
def test_search_by_column_equals_brute_force(spark, monkeypatch, columns, share):
    monkeypatch.setattr(knn, "CELL_ROWS", 32)
    monkeypatch.setattr(knn, "ONE_SHARED", 0)
    assert compare_scattered(spark, scattered(700, columns, share, 5), block_rows=100)["index"] == "columns"


def test_search_by_column_with_ties_and_copies(spark, untidy, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    monkeypatch.setattr(knn, "ONE_SHARED", 0)
    check(spark, untidy)
    check(spark, untidy.head(60), k=90)  # fewer donors than k


def test_few_cells_for_each_gap(spark):
    """Gaps all over six columns: some slices per tuple, not a share of the table."""
    pdf = scattered(20_000, 6, 0.35, 9)
    report = {}
    knn.knn_impute(frame(spark, pdf), report=report)
    print("routed for each gap:", report["routed"] / report["gaps"], report)
    assert report["index"] == "columns" and report["routed"] <= 10 * report["gaps"]


def test_wide_tables_of_many_patterns(spark):
    report = compare_scattered(spark, scattered(1_200, 14, 0.35, 10))
    assert report["index"] == "grid"


def test_products_choose_what_pairs_choose():
    pdf = scattered(300, 5, 0.4, 12).round(0)  # many ties
    data = pdf.to_numpy(dtype=float)
    gaps, donors = data[:60], data[60:]
    def best(found):
        out = {}
        for f, gap, donor, d in found:
            for g, x, away in zip(gap.tolist(), donor.tolist(), d.tolist()):
                out.setdefault((int(f), g), set()).add((away, x))
        return {key: {p for p in v if p[0] <= sorted(v)[min(5, len(v)) - 1][0]} for key, v in out.items()}

    pairs = knn._pattern_pairs(gaps, knn._by_pattern(gaps), donors, knn._by_pattern(donors), 5)
    assert best(pairs) == best(knn._by_products(gaps, donors, 5))


def boxes(side, draw):
    """Cells of a square grid in two columns, 20 donors each, the third column theirs alone."""
    corners = np.array([(i, j, 0.0) for i in range(side) for j in range(side)], dtype=float)
    inside = corners[:, None, :] + draw.random((len(corners), 20, 3))
    return inside.min(axis=1), inside.max(axis=1), np.full(len(corners), 20), inside[:, :3].reshape(-1, 3)


@pytest.mark.parametrize("mixed, at", [(False, (3.0, 7.0)), (True, (3.0, 7.0)), (False, (-50.0, 90.0))])
def test_gaps_side_by_side_meet_the_cells_around_only(mixed, at):
    """The same cells as by a search in all of them, which took a step for each gap and cell."""
    draw = np.random.default_rng(11)
    low, high, copies, samples = boxes(30, draw)
    complete = np.array([True, True, False])
    points = np.column_stack([draw.random((64, 2)) + at, np.full(64, np.nan)])
    near, met = knn._cells_near(points, low, high, copies, samples, 5, mixed, complete)
    want, far = knn._cells_to_search(points, low, high, copies, samples, 5, mixed, complete)
    got, reach = knn._cells_to_search(points, low[near], high[near], copies[near], samples[met], 5, mixed, complete)
    assert np.array_equal(want[:, near], got) and want.sum() == got.sum() and np.array_equal(far, reach)
    assert len(near) < len(low) / 10


def test_a_block_makes_one_frame(monkeypatch):
    """Not one for each batch of gaps and column, which took longer than the search in it."""
    pdf = scattered(400, 6, 0.35, 3)
    names = list(pdf.columns)
    rows = pdf.assign(rid=np.arange(len(pdf)), n=1)
    made, frame_of = [], pd.DataFrame
    monkeypatch.setattr(knn.pd, "DataFrame", lambda *a, **b: made.append(1) or frame_of(*a, **b))
    found = knn._nearest(rows, rows, names, 5)
    assert len(made) == 1 and len(found) == 5 * int(pdf.dropna(how="all").isna().to_numpy().sum())


def test_cells_hold_as_many_tuples_where_columns_go_together(spark, monkeypatch):
    """Slices of each column left most cells of such a table empty, and the rest was cut again along the
    column that gaps do not have: a gap met a share of the table."""
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    monkeypatch.setattr(knn, "CUT_FROM", 16)
    draw = np.random.default_rng(21)
    key = np.arange(2_000.0)
    pdf = pd.DataFrame({"key": key, "other": key // 200 * 20 + draw.random(2_000) * 20, "price": draw.random(2_000) * 1e6})
    pdf.loc[draw.random(2_000) < 0.1, "price"] = np.nan
    report = compare_scattered(spark, pdf, max_cells=100)
    print("routed for each gap:", report["routed"] / report["gaps"], report)
    assert report["index"] == "grid" and report["cells"] >= 80 and report["routed"] <= 5 * report["gaps"]


def test_trees_have_balanced_leaves():
    draw = np.random.default_rng(4)
    points = np.column_stack([draw.integers(0, 3, 4_000), draw.normal(0, 9, 4_000), draw.normal(0, 1e6, 4_000)])
    nodes = []
    root = knn._grow(nodes, points, 13, np.array([5.0, 5.0, 0.0]))
    trees = ({(True, True, True): root}, *map(np.array, zip(*nodes)))
    leaves, sizes = np.unique(knn._leaves(points, trees), return_counts=True)
    assert len(leaves) == 13 and sizes.max() < 1.2 * sizes.min()
    assert 2 not in {c for c, cut, *_ in nodes if np.isfinite(cut)}  # no gap has it
    strange = np.array([[np.nan, 1.0, 2.0], [np.nan] * 3])
    assert knn._leaves(strange, trees).tolist() == [-1, -1]
    assert len(set(knn._leaves(strange, ({None: root}, *trees[1:])).tolist()) - {-1}) == 1


@pytest.mark.parametrize("reach", [np.inf, 12.0])
def test_parts_of_a_block_hold_all_neighbours(reach):
    """Ties too; and a gap is not compared with all of the block."""
    draw = np.random.default_rng(8)
    donors, points = draw.integers(0, 60, (3_000, 2)).astype(float), draw.integers(-5, 65, (200, 2)).astype(float)
    found = set()
    for p, d, away in knn._closest(points, donors, 5, 1.5, np.full(200, reach), 64):
        assert not found & set(zip(p.tolist(), d.tolist()))
        found |= set(zip(p.tolist(), d.tolist()))
    every = ((points[:, None] - donors[None]) ** 2).sum(axis=2) * 1.5
    kth = np.minimum(np.sort(every, axis=1)[:, 4], reach)
    assert set(zip(*(i.tolist() for i in np.nonzero(every <= kth[:, None])))) <= found
    assert len(found) < every.size / 50


def test_only_the_fills_stay_in_scratch(spark, untidy, tmp_path, monkeypatch):
    """All tables of the search stayed: tuples, gaps, blocks."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    filled = knn.knn_impute(frame(spark, untidy))
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["knn-fills"]
    assert filled.count() == len(untidy)
