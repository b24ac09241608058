"""Queries over awkward forms of the given tables, with their SQL twins: gaps on both sides
of a pair, line breaks, truth values, decimals, large keys, names in use, forms of dates."""

from pyspark.sql import functions as F

from clearwell.functions.storage import fresh_path
from clearwell.functions.types import ref
from clearwell.operators import columns, encode, isolation, missing, outliers, text
from clearwell.plans import chartdata, insights, profile, profile_state, suggest
from clearwell.sources import reader, writer

from .inputs import cleaned, dirty, table
from .oracle import ORACLE_SQL as MAIN_SQL, CLEANED, DIRTY, KNN, NULL_TOKENS, described, histogram, mode_of, trend_block, INSIGHT, LINE_NUMERIC

GAPS = """with gaps as (select
    case when l_orderkey % 5 = 0 then null else l_quantity end as a,
    case when l_partkey % 4 = 0 then null else l_quantity * 100 + l_extendedprice / 1000 end as b,
    case when l_suppkey % 3 = 0 then null else l_discount + l_quantity / 1000 end as c,
    case when l_orderkey % 7 = 0 then 4.0 end as d
  from lineitem)"""
PAIRS = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]


def gaps(spark, folder):
    df = table(spark, folder, "lineitem")
    quantity = F.col("l_quantity")
    return df.select(
        F.when(F.col("l_orderkey") % 5 != 0, quantity).alias("a"),
        F.when(F.col("l_partkey") % 4 != 0, quantity * 100 + F.col("l_extendedprice") / 1000).alias("b"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_discount") + quantity / 1000).alias("c"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(4.0)).alias("d"),
    )


def i2_correlations_gaps(spark, folder):
    found = insights.correlation_insights(gaps(spark, folder))
    return found.select(F.array_join("columns", ",").alias("columns"), F.round("score", 6).alias("score"))


def v3_correlation_matrix_gaps(spark, folder):
    return chartdata.correlation_matrix(gaps(spark, folder), digits=6)


def s4_export_csv_documents(spark, folder):
    docs = table(spark, folder, "documents")
    path = writer.export_csv(docs, fresh_path(spark, "export"), "documents")
    df, _ = reader.load_dataset(spark, path)
    return df


def s4_export_csv_conversations(spark, folder):
    path = writer.export_csv(table(spark, folder, "conversations"), fresh_path(spark, "export"), "conversations")
    df, _ = reader.load_dataset(spark, path)
    return df


def typed(spark, folder):
    """Orders with a truth value, a decimal, a key beyond 2^53 and one constant key."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        (key % 20 == 0).alias("rare"),
        F.when(key % 9 != 0, (F.lit(9) + key % 3).cast("decimal(12,2)")).alias("amount"),
        (F.lit(1 << 60) + key % 3).alias("far_key"),
        F.lit(1 << 60).alias("one_key"),
        F.col("o_orderpriority").alias("prio"),
    )


TYPED = """with typed as (select o_orderkey % 20 = 0 as rare,
    case when o_orderkey % 9 <> 0 then cast(9 + o_orderkey % 3 as decimal(12, 2)) end as amount,
    1152921504606846976 + o_orderkey % 3 as far_key, 1152921504606846976 as one_key, o_orderpriority as prio from orders)"""


def m5_feature_types_typed(spark, folder):
    return profile.detect_feature_types(typed(spark, folder))


def c4_mode_fill_decimal(spark, folder):
    return missing.handle_missing_values(typed(spark, folder), "Mode").select("amount", "far_key")


def g1_rule_suggestions_typed(spark, folder):
    """Which rules speak of which column; figures are left to the other entries."""
    found = suggest.rule_based_suggestions(typed(spark, folder).select("rare", "far_key", "one_key"))
    return found.where(ref("Column") != "-").select("Column", F.regexp_extract("Issue Detected", "^[A-Za-z ]+", 0).alias("issue"))


def g2_basic_suggestions_typed(spark, folder):
    found = suggest.rule_based_suggestions(typed(spark, folder).select("rare", "one_key"), rules="basic")
    return found.select("position", "Column", "Issue Detected")


def c17_label_encode_again(spark, folder):
    once = encode.label_encode(dirty(spark, folder), "prio")
    return encode.label_encode(once, "prio").select("o_orderkey", "prio", "prio_encoded")


def c18_factorize_again(spark, folder):
    once = encode.factorize(dirty(spark, folder), "price", order_by="o_orderkey")
    return encode.factorize(once, "price", order_by="o_orderkey").select("o_orderkey", "price", "price_encoded")


def c19_one_hot_case(spark, folder):
    df = table(spark, folder, "orders")
    low = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    return encode.one_hot_encode(df.select("o_orderkey", low.alias("s"), F.lit(1).alias("s_O")), "s")


def c19_one_hot_many(spark, folder):
    df = encode.one_hot_encode(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", max_columns=50)
    return df.select("p_partkey", F.array_join(F.map_keys("p_name_one_hot"), ",").alias("name"))


def c5_knn_impute_names(spark, folder):
    """Neighbours in a table whose columns bear the names that a search might use."""
    renamed = {"o_orderkey": "y0", "o_custkey": "n", "price": "value", "prio": "tuple", "status": "cell"}
    df = missing.handle_missing_values(dirty(spark, folder).withColumnsRenamed(renamed), "KNN Imputation")
    return df.withColumns({"value": F.round("value", 4), "odate": F.col("odate").cast("string")})


def c5_knn_impute_several(spark, folder):
    """Two columns with gaps; how many are left, and the fills' sum."""
    df = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 10 != 3, F.col("c_acctbal")).alias("x"),
        F.when(F.col("c_custkey") % 10 != 7, F.col("c_acctbal") * 2 + F.col("c_custkey")).alias("y"),
    )
    out = missing.handle_missing_values(df, "KNN Imputation")
    return out.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def c15_mapping_table(spark, folder):
    """The mapping is a table: part brands to their makers, in other spellings."""
    part = table(spark, folder, "part")
    mapping = part.select(
        F.concat(F.lit(" "), F.upper("p_brand")).alias("source"), F.concat(F.lit("maker "), F.substring("p_brand", 7, 1)).alias("target"))
    cells = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("b"))
    return text.standardize_categories(cells, "b", mapping)


def s5_report_sections(spark, folder):
    """Every section of the report, as written: its rows."""
    target = fresh_path(spark, "report")
    index = writer.write_report(dirty(spark, folder), cleaned(spark, folder), target, None, ["o_orderkey"])
    counts = None
    for row in index.collect():  # one row per section
        part = spark.read.parquet(row["path"]).agg(F.lit(row["section"]).alias("section"), F.count(F.lit(1)).alias("rows"))
        counts = part if counts is None else counts.union(part)
    return counts


def p3_change_type_forms(spark, folder):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    forms = (
        "M/d/yyyy", "MM/dd/yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/M/d", "MMM d, yyyy", "d MMMM yyyy", "dd.MM.yyyy",
        "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd", "d-M-yyyy",
    )
    written = F.coalesce(*[F.when(key % len(forms) == i, F.date_format(day, f)) for i, f in enumerate(forms)])
    df = table(spark, folder, "orders").select("o_orderkey", written.alias("placed"))
    return columns.change_type(df, "placed", "datetime").withColumn("placed", F.col("placed").cast("string"))


def i4_trend_text_dates(spark, folder):
    """Dates as text, and several numeric columns of which the widest is the target."""
    df = table(spark, folder, "events").select(
        F.date_format("ts", "M/d/yyyy").alias("event_date"), (F.col("user_id") % 7).alias("small"),
        ((F.col("value") + F.dayofmonth("ts")) * 1000).alias("level"), (F.col("event_id") % 5).alias("least"),
    )
    found = insights.trend_insights(df)
    return found.withColumns({"score": F.round("score", 6), "columns": F.array_join("columns", ",")})


def _write_lines(df, line, header, path):
    """Raw lines under a raw header, as they stand."""
    first = F.monotonically_increasing_id() % F.lit(1 << 33) == 0  # of its file
    df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line)).write.text(path)


def s1_load_csv_surplus(spark, folder):
    """Rows with more cells than the header, empty ones among them; how many is told."""
    key, more = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, ",").when(F.col("o_orderkey") % 11 == 0, ",,5").otherwise("")
    path = fresh_path(spark, "lines")
    _write_lines(table(spark, folder, "orders"), F.concat(key.cast("string"), F.lit(","), F.col("o_orderpriority"), more), "k,prio", path)
    df, info = reader.load_dataset(spark, path, format="csv", surplus="report")
    return df.withColumn("surplus_rows", F.lit(info.first()["surplus_rows"]))


def s1_load_csv_headers(spark, folder):
    """Files of one folder with their columns in another order, more of them, and equal names."""
    orders, path = table(spark, folder, "orders").where("o_orderkey % 3 < 2"), fresh_path(spark, "headers")
    key, prio = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    _write_lines(orders.where("o_orderkey % 3 = 0"), F.concat_ws(",", key, prio, F.lit("a")), "k,prio,prio", f"{path}/part=1")
    _write_lines(orders.where("o_orderkey % 3 = 1"), F.concat_ws(",", F.lit("b"), F.concat(F.lit('"'), prio, F.lit('\nx"')), key), "more,prio,k", f"{path}/part=2")
    df, _ = reader.load_dataset(spark, f"{path}/*", format="csv")
    return df.select("k", "prio", ref("prio.1").alias("prio_1"), "more")


def p3_change_type_zones(spark, folder):
    """Times with one zone keep their clock; times of several zones become UTC."""
    key, when = F.col("o_orderkey"), F.to_timestamp_ntz(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 10:20:30")), F.lit("yyyy-MM-dd HH:mm:ss"))
    shown = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(shown, F.when(key % 2 == 0, "+02:00").otherwise("+0200")).alias("one"),
        F.concat(F.date_format(when, "EEE, d MMM yyyy HH:mm:ss"), F.when(key % 3 == 0, "Z").when(key % 3 == 1, " -0530").otherwise(" UTC+01:00")).alias("several"))
    for c in ("one", "several"):
        df = columns.change_type(df, c, "datetime").withColumn(c, F.col(c).cast("string"))
    return df


def p3_change_type_day_first(spark, folder):
    """Columns that write the day first, with years of four and of two digits, and one that does not."""
    day = F.col("o_orderdate")
    forms = {"slashes": "dd/MM/yyyy", "short": "d-M-yy", "clock": "dd/MM/yyyy HH:mm", "month_first": "MM-dd-yyyy", "named": "dd-MMM-yy"}
    df = table(spark, folder, "orders").select("o_orderkey", *[F.date_format(day, f).alias(n) for n, f in forms.items()])
    for c in forms:
        df = columns.change_type(df, c, "datetime").withColumn(c, F.col(c).cast("date").cast("string"))
    return df


def v8_daily_series_text(spark, folder):
    """Days written with the day first: no row is lost, no day mistaken."""
    events = table(spark, folder, "events").select(F.date_format("ts", "dd/MM/yyyy HH:mm").alias("at"), "value")
    df = chartdata.daily_series(events, "at", "value")
    return df.select(F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"))


WIDE = {"x1": (7919, 11, 3571), "x2": (104729, 23, 2221), "x3": (1299709, 37, 1117), "x4": (15485863, 53, 733), "x5": (32452843, 71, 397), "x6": (49979687, 89, 173)}


def c5_knn_impute_wide(spark, folder):
    """Gaps scattered over all six columns."""
    key = F.col("c_custkey")
    df = table(spark, folder, "customer").select(*[
        F.when((key * a + b) % 97 >= 44, (key * m % 10007) / 100.0 + F.col("c_acctbal") / 10000.0).alias(c) for c, (a, b, m) in WIDE.items()],
        key.cast("string").alias("c_custkey"))
    out = missing.handle_missing_values(df, "KNN Imputation")
    return out.select("c_custkey", *[F.round(c, 3).alias(c) for c in WIDE])


def c17_label_encode_dotted(spark, folder):
    df = dirty(spark, folder).withColumnRenamed("prio", "order.prio d")
    return encode.label_encode(df, "order.prio d").select("o_orderkey", ref("order.prio d_encoded").alias("code"))


def m4_numeric_summary_all(spark, folder):
    return profile.numeric_summary(table(spark, folder, "lineitem"))


def m2_dtype_summary_sketched(spark, folder):
    """Distinct counts by sketches: within 2 % of the exact ones."""
    df = table(spark, folder, "lineitem")
    exact = profile.dtype_summary(df).select("Column", ref("Unique Values").alias("exact"))
    found = profile.dtype_summary(df, accuracy=0.005).join(exact, "Column")
    close = F.abs(ref("Unique Values") - F.col("exact")) <= F.col("exact") * 0.02
    return found.select("Column", ref("Non-Null Count").alias("present"), ref("Missing Count").alias("missing"), "exact", close.alias("close"))


def m4_numeric_summary_merged(spark, folder):
    """Moments of ten parts, profiled one by one and merged."""
    df = table(spark, folder, "lineitem")
    parts = profile_state.states(df, F.pmod("l_orderkey", F.lit(10)).cast("string"))
    found = profile_state.summary(profile_state.merged(parts), digits=3).where(ref("count").isNotNull())
    return found.select("Column", "count", "mean", "std", "min", "max")


def b1_before_after_merged(spark, folder):
    """Both versions from their states; repeated rows, an estimate, are left out."""
    both = [profile_state.merged(profile_state.states(t, n)) for t, n in ((dirty(spark, folder), "raw"), (cleaned(spark, folder), "clean"))]
    found = profile_state.comparison(*both)
    return found.where(~ref("Metric").contains("uplicate"))


def v11_distribution_shift_first(spark, folder):
    """The first numeric column of both versions, chosen by the operator."""
    df = chartdata.distribution_shift(dirty(spark, folder), cleaned(spark, folder))
    return df.withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


def _with_planted(spark, folder):
    """All numeric columns of the line items; every 500th line lies far outside."""
    df = table(spark, folder, "lineitem").withColumn("planted", (F.col("l_orderkey") % 500 == 1))
    far = {c: F.when(F.col("planted"), F.col(c).cast("double") * 40 + 9e5).otherwise(F.col(c).cast("double"))
           for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    return df.withColumns(far)


def c10_isolation_forest_checked(spark, folder):
    """All numeric columns and a key: rows, a flagged share within bounds, planted rows found."""
    df = isolation.flag_anomalies(_with_planted(spark, folder), key=["l_orderkey", "l_linenumber"])
    found = F.count_if(F.col("is_outlier") & F.col("planted")) / F.count_if("planted")
    share = F.count_if("is_outlier") / F.count(F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("rows"), share.between(0.04, 0.051).alias("share_holds"), (found > 0.95).alias("planted_found"))


def c11_remove_outliers_forest(spark, folder):
    df = outliers.remove_outliers(_with_planted(spark, folder), "Isolation Forest", key=["l_orderkey", "l_linenumber"])
    total = table(spark, folder, "lineitem").count()
    kept = F.count(F.lit(1)) / F.lit(total)
    return df.agg(kept.between(0.949, 0.96).alias("share_holds"), (F.count_if("planted") < 0.05 * total / 500).alias("planted_gone"))


QUERIES = {
    name: query for name, query in list(globals().items())
    if name[0] in "spmcgivb" and name[1].isdigit() and callable(query)
}

_DAY = "cast(o_orderdate as date)"
_HARD_PAIRS = " union all ".join(f"select {k} as o, '{x},{y}' as columns, corr({x}, {y}) as r from gaps" for k, (x, y) in enumerate(PAIRS) if "d" not in (x, y))
_MATRIX = " union all ".join(
    f"select '{x}' as x, '{y}' as y, "
    + ("cast(null as double) as r" if "d" in (x, y) else "1.0 as r" if x == y else f"round(corr({x}, {y}), 6) as r from gaps")
    for x in "abcd" for y in "abcd"
)
def _wide_fill(c):
    return f"""f_{c} as (select k, avg(v) as fill from (select g.k, h.{c} as v, row_number() over (partition by g.k order by d, h.{c}) as place
    from pairs p join t g on g.k = p.g join t h on h.k = p.h where g.{c} is null and h.{c} is not null) where place <= 5 group by k)"""


_WIDE = f"""with t as (select c_custkey as k, {', '.join(
    f"case when (c_custkey * {a} + {b}) % 97 >= 44 then (c_custkey * {m} % 10007) / 100.0::double + c_acctbal / 10000.0::double end as {c}" for c, (a, b, m) in WIDE.items())}
    from customer),
  shared as (select g.k as g, h.k as h, {' + '.join(f'(g.{c} is not null and h.{c} is not null)::int' for c in WIDE)} as n,
    {' + '.join(f'coalesce((g.{c} - h.{c}) * (g.{c} - h.{c}), 0)' for c in WIDE)} as total
    from t g, t h where {' or '.join(f'g.{c} is null' for c in WIDE)}),
  pairs as (select g, h, total * (6.0::double / n) as d from shared where n > 0), {', '.join(_wide_fill(c) for c in WIDE)}
  select cast(t.k as varchar) as c_custkey, {', '.join(f'round(coalesce({c}, f_{c}.fill, (select avg({c}) from t)), 3) as {c}' for c in WIDE)}
  from t {' '.join(f'left join f_{c} on f_{c}.k = t.k' for c in WIDE)}"""
_CLOCK = "cast(cast(o_orderdate as date) as timestamp) + interval '10 hours 20 minutes 30 seconds'"
_DATE_TEXT = f"cast({_DAY} as varchar)"
_CLEAN = lambda c: f"case when {c} in {NULL_TOKENS} then null else {c} end as {c}"

ORACLE_SQL = {
    "i2_correlations_gaps": f"{GAPS} select columns, round(abs(r) * 2, 6) as score from ({_HARD_PAIRS}) where abs(r) >= 0.4",
    "v3_correlation_matrix_gaps": f"{GAPS} {_MATRIX}",
    "s4_export_csv_documents": f"select doc_id, {_CLEAN('text')}, {_CLEAN('lang')}, {_CLEAN('source')}, n_chars from documents",
    "s4_export_csv_conversations": f"select conv_id, turn, {_CLEAN('role')}, {_CLEAN('text')} from conversations",
    "m5_feature_types_typed": f"""{TYPED} select * from (values ('rare', 'boolean', 'Numeric'), ('amount', 'decimal(12,2)', 'Numeric'),
    ('far_key', 'bigint', 'Numeric'), ('one_key', 'bigint', 'Numeric'), ('prio', 'string', 'Categorical')) v("Column", "Data Type", "Inferred Type"),
  lateral (select case "Column" when 'rare' then count(distinct rare) when 'amount' then count(distinct amount)
    when 'far_key' then count(distinct far_key) when 'one_key' then count(distinct one_key) else count(distinct prio) end as "Unique Values" from typed)""",
    "c4_mode_fill_decimal": f"{TYPED} select coalesce(amount, {mode_of('amount', 'typed')}) as amount, far_key from typed",
    "g1_rule_suggestions_typed": TYPED + " " + " union all ".join(
        f"""select '{c}' as "Column", 'Constant values' as issue from typed having count(distinct {c}) = 1
  union all select '{c}', 'Skewed ' from typed having count(distinct {c}) > 1 and abs(skewness({x})) > 1"""
        for c, x in (("rare", "rare::int"), ("far_key", "(far_key - 1152921504606846976)::double"), ("one_key", "0.0"))),
    "g2_basic_suggestions_typed": TYPED + """, few as (
    select 0 as place, 'rare' as c from typed having count(distinct rare) < 10
    union all select 1, 'one_key' from typed having count(distinct one_key) < 10)
  select cast(row_number() over (order by place) - 1 as int) as position, c as "Column", 'Numeric with low cardinality' as "Issue Detected" from few""",
    "c17_label_encode_again": f"""{DIRTY} select o_orderkey, prio,
  dense_rank() over (order by coalesce(prio, 'NA')) - 1 as prio_encoded from dirty""",
    "c18_factorize_again": f"""{DIRTY}, codes as (
    select price as p, row_number() over (order by min(o_orderkey), price) - 1 as code from dirty where price is not null group by price)
  select o_orderkey, price, coalesce(code, -1) as price_encoded from dirty left join codes on p = price""",
    "c19_one_hot_case": """with o as (select o_orderkey, 1 as s_O,
    case when o_orderkey % 2 = 0 then lower(o_orderstatus) else o_orderstatus end as s from orders)
  select o_orderkey, s_O, s = 'F' as s_F, s = 'O' as s_O_2, s = 'P' as s_P, s = 'f' as s_f_2, s = 'o' as s_o_3, s = 'p' as s_p_2 from o""",
    "c19_one_hot_many": "select p_partkey, p_name as name from part",
    "c5_knn_impute_names": f"""select o_orderkey as y0, o_custkey as n, prio as "tuple", price as value, status as cell, odate from ({KNN})""",
    "c5_knn_impute_several": """with t as (select c_custkey::double as k,
    case when c_custkey % 10 <> 3 then c_acctbal end as x, case when c_custkey % 10 <> 7 then c_acctbal * 2 + c_custkey end as y from customer),
  d as (select g.k, g.x, g.y, h.x as hx, h.y as hy,
    3.0 / (1 + (g.x is not null and h.x is not null)::int + (g.y is not null and h.y is not null)::int)
      * ((g.k - h.k) * (g.k - h.k) + coalesce((g.x - h.x) * (g.x - h.x), 0) + coalesce((g.y - h.y) * (g.y - h.y), 0)) as dist
    from t g, t h where g.x is null or g.y is null),
  fx as (select k, avg(hx) as fill from (select k, hx, row_number() over (partition by k order by dist, hx) as place from d where x is null and hx is not null) where place <= 5 group by k),
  fy as (select k, avg(hy) as fill from (select k, hy, row_number() over (partition by k order by dist, hy) as place from d where y is null and hy is not null) where place <= 5 group by k)
  select t.k as c_custkey, round(coalesce(x, fx.fill), 3) as x, round(coalesce(y, fy.fill), 3) as y
  from t left join fx on fx.k = t.k left join fy on fy.k = t.k""",
    "c15_mapping_table": """select p_partkey, case when p_partkey % 3 = 0 then 'maker ' || substr(p_brand, 7, 1)
  when p_partkey % 7 <> 0 then p_type end as b from part""",
    "s5_report_sections": f"""{DIRTY}, missing as (select (count(*) filter (prio is null) > 0)::int + (count(*) filter (price is null) > 0)::int
    + (count(*) filter (status is null) > 0)::int as n from dirty)
  select section, cast(rows as bigint) as rows from (values ('1_summary', 1), ('2_quality', 1), ('3_comparison', 7), ('4_schema', 6),
    ('5_cleaning_log', 0), ('6_statistics', 3), ('7_preview_before', 5), ('7_preview_after', 5), ('8_2_impact', 4), ('8_3_shift', 60),
    ('8_4_distributions', 75), ('8_5_correlation', 9)) v(section, rows)
  union all select '8_1_missing', n from missing""",
    "p3_change_type_forms": f"""select o_orderkey, cast(cast({_DAY} as timestamp) as varchar) as placed from orders""",
    "s1_load_csv_surplus": """select o_orderkey as k, o_orderpriority as prio,
  (select count(*) from orders where o_orderkey % 7 = 0 or o_orderkey % 11 = 0) as surplus_rows from orders""",
    "s1_load_csv_headers": """select o_orderkey as k, case when o_orderkey % 3 = 0 then o_orderpriority else o_orderpriority || chr(10) || 'x' end as prio,
  case when o_orderkey % 3 = 0 then 'a' end as prio_1, case when o_orderkey % 3 = 1 then 'b' end as more from orders where o_orderkey % 3 < 2""",
    "p3_change_type_zones": f"""select o_orderkey, cast({_CLOCK} as varchar) as one,
  cast({_CLOCK} - case o_orderkey % 3 when 0 then interval '0 minutes' when 1 then interval '-330 minutes' else interval '60 minutes' end as varchar) as several
  from orders""",
    "p3_change_type_day_first": f"""select o_orderkey, {_DATE_TEXT} as slashes, {_DATE_TEXT} as short, {_DATE_TEXT} as clock,
  {_DATE_TEXT} as month_first, {_DATE_TEXT} as named from orders""",
    "v8_daily_series_text": "select cast(cast(ts as date) as varchar) as day, round(avg(value), 6) as mean from events group by 1",
    "c5_knn_impute_wide": _WIDE,
    "c17_label_encode_dotted": f"{DIRTY} select o_orderkey, dense_rank() over (order by coalesce(prio, 'NA')) - 1 as code from dirty",
    "i4_trend_text_dates": f"""with e as (select ts as event_date, (value + day(ts)) * 1000 as level from events)
  select {INSIGHT} from ({trend_block('e', 'event_date', 'level')})""",
    "m4_numeric_summary_all": described("lineitem", LINE_NUMERIC),
    "m2_dtype_summary_sketched": " union all ".join(
        f"select '{c}' as \"Column\", count({c}) as present, count(*) - count({c}) as missing, count(distinct {c}) as exact, true as close from lineitem"
        for c in (*LINE_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate")),
    "m4_numeric_summary_merged": " union all ".join(
        f"""select '{c}' as "Column", count({c})::double as count, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std,
  round(min({c})::double, 3) as min, round(max({c})::double, 3) as max from lineitem""" for c in LINE_NUMERIC),
    "b1_before_after_merged": f"select * from ({MAIN_SQL['b1_before_after']}) where \"Metric\" not like '%uplicate%'",
    "v11_distribution_shift_first": f"""{CLEANED} ({histogram('dirty', 'o_orderkey', 30, version='Before')})
  union all ({histogram('cleaned', 'o_orderkey', 30, version='After')})""",
    "c10_isolation_forest_checked": "select count(*) as rows, true as share_holds, true as planted_found from lineitem",
    "c11_remove_outliers_forest": "select true as share_holds, true as planted_gone",
}
