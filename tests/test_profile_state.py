import numpy as np
import pandas as pd
import pytest

from clearwell.plans import compare, profile, profile_state
from clearwell.plans.profile_state import ProfileStore, merged, metrics, states, summary


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"a": draw.gamma(2, 3, n), "b": draw.integers(0, 40, n).astype(float) + 1e7, "t": draw.choice(list("xyz"), n)})
    pdf.loc[draw.random(n) < 0.1, "a"] = np.nan
    pdf = pd.concat([pdf, pdf.head(60)])
    rows = [(i % 10, None if np.isnan(a) else float(a), float(b), None if i % 17 == 0 else t, i % 3 == 0) for i, (a, b, t) in enumerate(pdf.to_numpy())]
    return spark.createDataFrame(rows, "file int, a double, b double, t string, flag boolean").repartition(4, "file").cache()


def close(got, want, tolerance=1e-6):
    return (got is None and want is None) or abs(got - want) <= tolerance * max(1.0, abs(want))


def test_merged_parts_equal_the_whole(spark, table, tmp_path):
    df = table.drop("file")
    store = ProfileStore(spark, str(tmp_path / "profile"))
    for k in range(10):
        assert store.add(table.where(f"file = {k}").drop("file"), f"file {k}")
    assert not store.add(df, "file 3")
    assert store.states().select("part").distinct().count() == 10
    got = {r["Column"]: r for r in summary(store.merged()).collect()}
    assert list(got) == df.columns
    for r in profile.dtype_summary(df).collect():
        mine = got[r["Column"]]
        assert all(mine[c] == r[c] for c in ("Data Type", "Non-Null Count", "Missing Count", "Missing %"))
        assert abs(mine["Unique Values"] - r["Unique Values"]) <= 0.03 * r["Unique Values"]
    for r in profile.numeric_summary(df).collect():
        mine = got[r["Column"]]
        assert all(close(mine[c], r[c], 2e-3) for c in ("count", "mean", "std", "min", "max", "skewness", "kurtosis")), (mine, r)
        spread = r["max"] - r["min"]
        assert all(abs(mine[c] - r[c]) <= 0.02 * spread for c in ("25%", "50%", "75%"))
    whole = {r["Column"]: r for r in summary(merged(states(df, "one"))).collect()}
    for name, r in whole.items():
        assert all(close(r[c], got[name][c], 2e-3) for c in ("mean", "std", "skewness", "kurtosis", "min", "max") if r[c] is not None)
    row, want = metrics(store.merged()).first(), profile.basic_metrics(df).first()
    assert (row["rows"], row["cols"], row["missing"]) == (want["rows"], want["cols"], want["missing"])
    assert abs(row["duplicates"] - want["duplicates"]) <= 0.02 * want["rows"]


def test_states_of_many_parts_at_once(table):
    by_file = states(table.drop("b"), table["file"])
    assert by_file.select("part").distinct().count() == 10
    assert summary(merged(by_file)).where("Column = 'a'").first()["Non-Null Count"] == table.where("a is not null").count()


def test_columns_come_and_go(spark):
    one = states(spark.createDataFrame([(1, "x"), (2, None)], "k int, t string"), "1")
    two = states(spark.createDataFrame([(5.0, 1)], "k double, z int"), "2")
    none = states(spark.createDataFrame([], "k int"), "3")
    got = {r["Column"]: r for r in summary(merged(one.unionByName(two).unionByName(none))).collect()}
    assert got["k"]["Data Type"] == "mixed" and got["k"]["mean"] == pytest.approx(8 / 3, abs=1e-4)
    assert (got["t"]["Non-Null Count"], got["t"]["Missing Count"], got["z"]["Missing Count"]) == (1, 2, 2)
    assert summary(merged(none)).count() == 0 and metrics(merged(none)).first()["rows"] == 0


def test_comparison_of_states(spark, full_df):
    clean = full_df.na.drop("any")
    got = profile_state.comparison(merged(states(full_df, "raw")), merged(states(clean, "clean"))).collect()
    assert got == compare.before_after(full_df, clean).collect()


def test_sketched_counts(spark):
    df = spark.range(60_000).selectExpr("id", "id % 7000 as some", "cast(if(id % 2 = 0, null, id % 5) as double) as few", "cast(id % 30000 as string) as text")
    exact = {r["Column"]: r for r in profile.dtype_summary(df).collect()}
    for r in profile.dtype_summary(df, accuracy=0.005).collect():
        want = exact[r["Column"]]
        assert abs(r["Unique Values"] - want["Unique Values"]) <= 0.02 * want["Unique Values"] and r["Missing Count"] == want["Missing Count"]
