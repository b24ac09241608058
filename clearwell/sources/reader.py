"""Loading a table: format by extension, missing markers, inferred types."""

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import stats
from ..functions.exprs import NULL_TOKENS, nan_to_null, null_if_token, to_double, to_whole
from ..functions.types import quoted, ref
from . import records

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}
# Texts read as true and false.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
# CSV options under which Spark's reader alone tells lines and cells apart.
OWN_READING = {"header", "escape", "multiline", "linesep", "encoding", "charset", "comment", "mode"}


def load_dataset(
    spark: SparkSession,
    path: str | None,
    format: str | None = None,
    infer_types: bool = True,
    surplus: str = "error",
    **options,
) -> tuple[DataFrame | None, DataFrame | None]:
    """The table and a one-row info frame (name, size_mb, type). ``path`` is a file, a
    folder or a glob; without a known extension name the ``format``. CSV needs a header
    line in every file and may be compressed; cells of files whose headers differ go by name, columns
    of equal names get numbers (``x``, ``x.1``). Line breaks inside quotes are found by one scan
    of the lines, and records are then put together in splits (``records``); lines end with LF or
    CRLF. A CSV row with more cells than the header of its file is an error, even if they are empty;
    with ``surplus="report"`` its surplus is left out and the info frame counts such rows
    (``surplus_rows``). A shorter row is filled up, and missing cells become NULL. ``options`` are those of
    Spark's reader; some (``OWN_READING``) leave all reading to it, whole files and one header for all."""
    if path is None:
        return None, None
    kind = format or next(
        (f for e, f in FORMATS.items() if path.lower().rstrip("/").endswith(e)), None
    )
    if kind not in FORMATS.values():
        raise ValueError("Unsupported file type. Please give a CSV, Parquet, JSON or ORC path.")
    if kind != "csv":
        df = nan_to_null(spark.read.options(**options).format(kind).load(path))
        return df, file_info(spark, path, kind)
    raw, wide_rows = _read_csv(spark, path, options)
    if wide_rows and surplus == "error":
        raise ValueError(f"{wide_rows} rows have more cells than the header")
    df = normalise_nulls(raw)
    info = file_info(spark, path, kind)
    if surplus == "report":
        info = info.withColumn("surplus_rows", F.lit(wide_rows).cast("bigint"))
    return infer_column_types(df) if infer_types else df, info


def _read_csv(spark: SparkSession, path: str, options: dict) -> tuple[DataFrame, int]:
    """All cells as text, and the number of rows with more cells than the header of their file."""
    quote, sep = options.get("quote", '"'), options.get("sep", options.get("delimiter", ","))
    if len(quote) != 1 or {o.lower() for o in options} & OWN_READING:
        return _read_plain(spark, path, options)
    options = {"escape": quote, **options}
    blocks = records.scan(spark, path, quote, sep)
    heads = blocks.where("header is not null").select("file", "header", records.cell_count(F.col("header"), quote, sep).alias("width"))
    kinds = heads.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()
    kinds = [r.header for r in kinds if r.header.strip()]
    if not kinds:
        return spark.createDataFrame([], T.StructType([])), 0
    broken = not blocks.where("breaks").isEmpty()
    if broken:
        rows = records.records(spark, path, blocks, quote, sep)
        widths = heads.select(F.col("file").alias("of"), "header", "width")
        rows = rows.join(widths, F.col("file") == F.col("of"))
        wide = rows.where(records.cell_count(F.col("record"), quote, sep) > F.col("width")).count()
    else:
        cells = blocks.select("file", F.explode("counts").alias("c")).join(heads, "file")
        wide = cells.where("c.cells > width").agg(F.coalesce(F.sum("c.n"), F.lit(0))).first()[0]
    parts = []
    for header in kinds:
        names = records.column_names(header, quote, sep)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if broken:
            parse = F.from_csv("record", _ddl(names), {**options, "multiLine": "true"})
            parts.append(rows.where(F.col("header") == header).select(parse.alias("cells")).select("cells.*"))
        else:
            files = path if len(kinds) == 1 else [_as_path(r.file) for r in heads.where(F.col("header") == header).select("file").collect()]
            parts.append(spark.read.options(**options).option("header", True).schema(schema).csv(files))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), wide


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{quoted(n)} string" for n in names)


def _as_path(uri: str) -> str:
    """A file as a path for reading: not encoded, and no letter of it a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _read_plain(spark: SparkSession, path: str, options: dict) -> tuple[DataFrame, int]:
    """For options that change how lines and cells are told apart: one header for all files,
    which are read whole if their quotes hold line breaks; surplus cells that are not empty count."""
    options = {"header": True, "escape": '"', **options}
    if "multiLine" not in options:
        options["multiLine"] = _breaks_in_quotes(spark, path, options.get("quote", '"'))
    reader = spark.read.options(**options, inferSchema=False)
    names = reader.csv(path).columns
    text = T.StringType()
    # One column more than the header holds what a longer row has next.
    extra = "__surplus"
    schema = T.StructType([T.StructField(n, text) for n in [*names, extra]])
    longer = reader.schema(schema).csv(path)
    wide = longer.where(ref(extra).isNotNull()).count()
    return longer.drop(extra), wide


def _breaks_in_quotes(spark: SparkSession, path: str, quote: str) -> bool:
    """A line that opens a quoted cell without closing it has an odd number of quotes."""
    if not quote:
        return False
    marks = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(marks % 2 == 1).isEmpty()


def file_info(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Size from the file listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return files.select("length").agg(
        F.lit(name).alias("name"),
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"),
        F.lit(kind.upper()).alias("type"),
    )


def normalise_nulls(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Texts that mark a missing cell become NULL; a lone blank stays."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_if_token(ref(c), tokens) for c in texts})


def inferred_types(df: DataFrame) -> DataFrame:
    """column, type: the narrowest of bigint, double, boolean and string that every
    non-NULL text of a column fits. Dates stay text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return stats.small_frame(df.sparkSession, [], "column string, type string")
    cell = F.col("cell")
    counted = (
        stats.unpivot(df, [[ref(c)] for c in texts], ["ordinal", "cell"])
        .groupBy("ordinal")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(cell).alias("n"),
            F.count(_whole_text(cell)).alias("whole"),
            F.count(to_double(cell, T.StringType())).alias("number"),
            F.count_if(cell.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias("truth"),
        )
    )
    names = stats.small_frame(df.sparkSession, list(enumerate(texts)), "ordinal int, column string")
    kind = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "double")
        .when(F.col("whole") == F.col("n"), "bigint")
        .when(F.col("number") == F.col("n"), "double")
        .when(F.col("truth") == F.col("rows"), "boolean")
        .otherwise("string")
    )
    # One row per column on both sides.
    return names.join(F.broadcast(counted), "ordinal", "left").select("column", kind.alias("type"))


def _whole_text(cell: Column) -> Column:
    return F.when(cell.rlike(r"^\s*[+-]?\d+\s*$"), cell.try_cast("bigint"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their inferred types; one aggregate, then a projection."""
    kinds = {r["column"]: r["type"] for r in inferred_types(df).collect()}
    text = T.StringType()
    new = {}
    for c, kind in kinds.items():
        if kind == "bigint":
            new[c] = to_whole(ref(c), text)
        elif kind == "double":
            new[c] = to_double(ref(c), text)
        elif kind == "boolean":
            new[c] = ref(c).isin(*TRUE_TEXTS)
    return df.withColumns(new) if new else df
