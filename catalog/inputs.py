"""Input tables of the catalog: the given parquet tables and views derived from them."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with NULLs, marker texts, stray blanks, negatives, outliers and copies."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    base = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 13 == 0, "N/A")
        .when(key % 17 == 0, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))
        .when(key % 19 == 0, F.lit(None))
        .otherwise(F.col("o_orderpriority"))
        .alias("prio"),
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 29 == 0, -price)
        .when(key % 101 == 0, price * 20)
        .otherwise(price)
        .alias("price"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("odate"),
    )
    return base.unionAll(base.where(key % 10 == 0))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """``dirty`` without incomplete rows and copies."""
    return dirty(spark, folder).na.drop("any").dropDuplicates()


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with gaps in a boolean, a date and a text column."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 23 != 0, F.col("o_totalprice") > 100_000).alias("big"),
        F.when(key % 31 != 0, F.to_date("o_orderdate")).alias("day"),
        F.when(key % 37 != 0, F.col("o_orderpriority")).alias("prio"),
    )


def typed_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with numbers and dates written in several ways."""
    key, number = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    date = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, F.concat(number, F.lit("d")))
        .when(key % 5 == 0, F.concat(number, F.lit(".5")))
        .when(key % 3 == 0, F.concat(F.lit(" "), number, F.lit(" ")))
        .otherwise(number)
        .alias("amount"),
        F.when(key % 6 == 0, "not a date")
        .when(key % 4 == 0, F.date_format(date, "MM/dd/yyyy"))
        .when(key % 3 == 0, F.date_format(date, "yyyy/MM/dd"))
        .otherwise(F.date_format(date, "yyyy-MM-dd"))
        .alias("placed"),
    )


def raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """``dirty`` as it would sit in a text file, markers in place of NULL."""
    df = dirty(spark, folder)
    key = F.col("o_orderkey")
    return df.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.coalesce("prio", F.lit("None")).alias("prio"),
        F.coalesce(F.col("price").cast("string"), F.lit("nan")).alias("price"),
        F.when(key % 3 == 0, F.coalesce("status", F.lit("#N/A")))
        .when(key % 3 == 1, F.coalesce("status", F.lit("")))
        .otherwise(F.coalesce("status", F.lit(" ")))
        .alias("status"),
        F.col("odate").cast("string").alias("odate"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("even"),
    )


def related(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with one column that follows another closely."""
    df = table(spark, folder, "lineitem")
    follow = F.col("l_quantity") * 100 + F.col("l_extendedprice") / 1000
    return df.withColumn("follow", follow)


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a level that rises over each month."""
    return table(spark, folder, "events").select(
        "ts", "event_type", (F.col("value") + F.dayofmonth("ts")).alias("level")
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """One model reply per conversation turn, some of them malformed."""
    key = F.col("conv_id") * 10 + F.col("turn")
    item = F.concat(
        F.lit('{"Column":"c'), F.col("turn").cast("string"),
        F.lit('","Issue Detected":"chars '), F.length("text").cast("string"),
        F.lit('","Suggestion":"Drop column","Severity":" '),
        F.when(key % 4 == 0, "high").when(key % 4 == 1, "LOW").when(key % 4 == 2, "urgent").otherwise("Info"),
        F.lit('"}'),
    )
    partial = F.lit('{"Column":"x","Severity":"High"}')
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(key % 9 == 0, F.concat(F.lit("No array here: "), item))
        .when(key % 9 == 1, F.concat(F.lit("Cut off ["), item))
        .when(key % 9 == 2, F.concat(F.lit("["), item, F.lit("] or ["), item, F.lit("]")))
        .when(key % 9 == 3, F.concat(F.lit("Sure: ["), partial, F.lit(","), item, F.lit("] done")))
        .when(key % 9 == 4, F.concat(F.lit('["note", 7, '), item, F.lit("]")))
        .otherwise(F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
        .alias("reply"),
    )
