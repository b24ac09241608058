import random

import pytest
from pyspark.sql import functions as F

from clearwell.operators import encode, invalid, missing, outliers, scale, text
from clearwell.sources import reader, records, writer
from clearwell.streaming.apply import apply_models

from .conftest import column


def test_load_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        'id,age,pay,note,flag,void\n1,30,1.5,"a, ""b""",True,\n2,NA,2,n/a,False,NULL\n3,,x, ,True,nan\n'
    )
    df, info = reader.load_dataset(spark, str(path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds == {"id": "bigint", "age": "bigint", "pay": "string", "note": "string", "flag": "boolean", "void": "double"}
    assert column(df, "note") == ['a, "b"', None, " "] and column(df, "age") == [30, None, None]
    row = info.first()
    assert (row["name"], row["type"]) == ("people.csv", "CSV") and row["size_mb"] == 0.0


def test_load_edges(spark):
    assert reader.load_dataset(spark, None) == (None, None)
    with pytest.raises(ValueError, match="Unsupported"):
        reader.load_dataset(spark, "table.xlsx")


def test_round_trip(spark, sample_df, tmp_path):
    path = writer.export_csv(sample_df, str(tmp_path), "sample")
    assert path.endswith("/sample_cleaned.csv")
    df, _ = reader.load_dataset(spark, path)
    assert sorted(map(str, df.collect())) == sorted(map(str, sample_df.collect()))
    stored = writer.export_parquet(sample_df.withColumn("age", F.coalesce("age", F.lit(float("nan")))), str(tmp_path))
    again, info = reader.load_dataset(spark, stored)
    assert column(again.where("age is null"), "salary") == [60000.0] and info.first()["type"] == "PARQUET"


def test_report(spark, sample_df, clean_df, tmp_path):
    index = writer.write_report(sample_df, clean_df, str(tmp_path / "a"), order_by=["age"])
    names = column(index, "section")
    assert names[0] == "1_summary" and len(names) == 13
    shown = spark.read.parquet(str(tmp_path / "a" / "7_preview_before"))
    assert shown.orderBy("#").first()["age"] == "—" and shown.count() == 5
    stats = spark.read.parquet(str(tmp_path / "a" / "6_statistics")).where("Column = 'age'").first()
    assert (stats["Mean"], stats["Count"]) == ("35.0000", "5.0000")


def test_report_of_emptied_table_uses_the_raw_one(sample_df):
    sections = writer.report_sections(sample_df, sample_df.limit(0))
    assert sections["1_summary"].first()["rows_after"] == 7
    void = writer.report_preview(sample_df.select())
    assert void.first()["Message"].startswith("No columns")


def test_fitted_models_on_a_stream(spark, sample_df, tmp_path):
    """Models fitted on a batch table clean a stream of files the same way."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    sample_df.repartition(3).write.parquet(source)
    models = [
        invalid.replace_invalid_values,
        missing.fit_fill(sample_df, "Mean", all_columns=True),
        outliers.fit_iqr(sample_df),
        scale.fit_scale(sample_df, "Standard"),
        text.standardize_text_columns,
        encode.fit_label(sample_df, "dept"),
        encode.fit_factorize(sample_df, "salary", "salary"),
        encode.fit_one_hot(sample_df, "dept"),
    ]
    stream = spark.readStream.schema(sample_df.schema).parquet(source)
    query = (
        apply_models(stream, models)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(target).collect()))
    assert got == sorted(map(str, apply_models(sample_df, models).collect()))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def split_finely(spark, size=331):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def fine_splits(spark):
    split_finely(spark)
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def awkward_cells(seed, n):
    draw = random.Random(seed)
    cells = ["plain", "a,b", 'he said ""x""', "two\nlines", "\n", "", 'ends with ""', "long " * 60 + "\n" + "text, " * 60, '5"" pipe', "x\r\ny", "naïve ✓"]
    return [(str(i), draw.choice(cells), draw.choice(cells)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_records_across_splits_equal_whole_files(fine_splits, tmp_path, seed):
    """Line breaks in quotes, delimiters and doubled quotes, cut in splits of some hundred bytes."""
    spark, folder = fine_splits, tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        lines = ["id,note,more"] + [",".join(f'"{c}"' if c != "plain" else c for c in row) for row in awkward_cells(10 * seed + part, 30)]
        if part == 1:
            lines.insert(5, '77,5" pipe,"q"z')  # quotes that are letters
            lines.insert(9, "")
        (folder / f"{part}.csv").write_bytes((("\r\n" if part == 2 else "\n").join(lines) + "\n" * (part != 0)).encode())
    assert records.lines(spark, str(folder)).rdd.getNumPartitions() > 20
    got, _ = reader.load_dataset(spark, str(folder), format="csv", infer_types=False)
    want = reader.normalise_nulls(spark.read.options(header=True, escape='"', multiLine=True).csv(str(folder)))
    # CRLF in quotes is text here; Spark's whole files have LF for it where their lines end in LF.
    one = lambda df: sorted([tuple(c and c.replace("\r\n", "\n") for c in r) for r in df.collect()], key=repr)
    assert one(got) == one(want) and got.count() == 91
    assert any("\r\n" in (c or "") for r in got.collect() for c in r)
    assert got.rdd.getNumPartitions() > 1


def test_states_of_lines(spark):
    cases = {
        "a,b": (False, True, 2), 'a,"b': (True, False, 2), '"': (True, False, 1), 'x"y': (False, False, 1), '"a""b",c': (False, False, 2),
        'a" ,"b': (True, True, 2), '""': (False, True, 1), '"""': (True, False, 1), 'x",y,"z': (True, True, 3), "": (False, True, 1), '"q"z,"': (True, True, 2),
    }
    got = spark.createDataFrame([(c,) for c in cases], "line string").select("line", *records.steps(F.col("line"), '"', ",")).collect()
    for r in got:
        # From inside a quote: the first quote closes, what follows goes on from there.
        assert (r.to0, r.cells) == (cases[r.line][0], cases[r.line][2]), r
    inside = {r.line: r.to1 for r in got}
    assert inside == {c: w[1] for c, w in cases.items()}


def test_surplus_cells_and_headers(spark, tmp_path):
    one, two, three = (tmp_path / "s" / f"{n}.csv" for n in "abc")
    one.parent.mkdir()
    one.write_text("x,y\n1,2\n3,4,,5\n")
    with pytest.raises(ValueError, match="1 rows have more cells"):
        reader.load_dataset(spark, str(one))
    two.write_text("y,x,z\n20,10\n21,11,31,\n")
    three.write_text('x,"y"\n"7\n7",8\n9,10,\n')
    df, info = reader.load_dataset(spark, str(one.parent), format="csv", surplus="report")
    assert df.columns == ["x", "y", "z"] and info.first()["surplus_rows"] == 3
    assert rows_of(df.select("x", "y", "z")) == sorted(
        [("1", 2, None), ("3", 4, None), ("10", 20, None), ("11", 21, 31), ("7\n7", 8, None), ("9", 10, None)], key=repr)
    three.write_text("x,y\n1,2,\n")
    with pytest.raises(ValueError, match="1 rows"):
        reader.load_dataset(spark, str(three))


def test_names_of_columns(spark, tmp_path):
    path = tmp_path / "odd [1].csv"
    path.write_text('\ufeffx,x,x.1,,X\n1,2,3,4,5\n', encoding="utf-8")
    df, _ = reader.load_dataset(spark, str(tmp_path), format="csv")
    assert df.columns == ["x", "x.2", "x.1", "Unnamed: 3", "X.3"] and rows_of(df) == [(1, 2, 3, 4, 5)]
    (tmp_path / "other.csv").write_text("x\n6\n")
    df, _ = reader.load_dataset(spark, str(tmp_path), format="csv")
    assert rows_of(df) == [(1, 2, 3, 4, 5), (6, None, None, None, None)]
    (tmp_path / "empty.csv").write_text("")
    assert reader.load_dataset(spark, str(tmp_path), format="csv")[0].count() == 2
    assert reader.load_dataset(spark, str(tmp_path / "empty.csv"))[0].columns == []


def test_options_that_leave_reading_to_spark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a;b\n1;"x\ny"\n2;z\n')
    df, _ = reader.load_dataset(spark, str(path), sep=";")
    again, _ = reader.load_dataset(spark, str(path), sep=";", multiLine=True)
    assert rows_of(df) == rows_of(again) == [(1, "x\ny"), (2, "z")]
