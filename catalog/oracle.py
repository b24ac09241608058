"""SQL twins of the catalog queries, in DuckDB's dialect, over the same tables."""

DIRTY = """with base as (
  select o_orderkey, o_custkey,
    case when o_orderkey % 13 = 0 then 'N/A'
         when o_orderkey % 17 = 0 then concat('  ', lower(o_orderpriority), ' ')
         when o_orderkey % 19 = 0 then null
         else o_orderpriority end as prio,
    case when o_orderkey % 11 = 0 then null
         when o_orderkey % 29 = 0 then -o_totalprice
         when o_orderkey % 101 = 0 then o_totalprice * 20
         else o_totalprice end as price,
    case when o_orderkey % 7 = 0 then null else o_orderstatus end as status,
    o_orderdate as odate
  from orders),
dirty as (
  select * from base
  union all
  select * from base where o_orderkey % 10 = 0)"""

CLEANED = f"""{DIRTY},
cleaned as (select distinct * from dirty
  where prio is not null and price is not null and status is not null)"""

RAW_TEXT = f"""{DIRTY},
raw_text as (
  select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey,
    coalesce(prio, 'None') as prio, coalesce(cast(price as varchar), 'nan') as price,
    case when o_orderkey % 3 = 0 then coalesce(status, '#N/A')
         when o_orderkey % 3 = 1 then coalesce(status, '')
         else coalesce(status, ' ') end as status,
    cast(odate as varchar) as odate,
    case when o_orderkey % 2 = 0 then 'True' else 'False' end as even,
    o_orderkey as k, price as p
  from dirty)"""

RELATED = """with related as (
  select *, l_quantity * 100 + l_extendedprice / 1000 as follow from lineitem)"""

DIRTY_NUMERIC = ("o_orderkey", "o_custkey", "price")
DIRTY_ALL = ("o_orderkey", "o_custkey", "prio", "price", "status", "odate")
# As in the package, written in SQL form.
NULL_TOKENS = """('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
  '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""
INVALID_TOKENS = "('na', 'n/a', 'none', '-', '--', 'null', 'nan')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || " + " || ".join(
    f"chr({c})" for c in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def fences(name, source, columns):
    """CTE with the quartiles of each column."""
    parts = ", ".join(
        f"quantile_cont({c}::double, {q}) as {c}_{n}"
        for c in columns
        for q, n in ((0.25, "q1"), (0.75, "q3"))
    )
    return f"{name} as (select {parts} from {source})"


def outside(column, t="t", f="f"):
    q1, q3, v = f"{f}.{column}_q1", f"{f}.{column}_q3", f"{t}.{column}::double"
    return (
        f"({q1} <> {q3} and not coalesce({v} between {q1} - 1.5 * ({q3} - {q1}) "
        f"and {q3} + 1.5 * ({q3} - {q1}), false))"
    )


def outside_any(columns, t="t", f="f"):
    return "(" + " or ".join(outside(c, t, f) for c in columns) + ")"


def nulls(columns, t=""):
    return " + ".join(f"({t}{c} is null)::int" for c in columns)


def metrics(name, source, columns, numeric):
    """CTEs with the metrics and the quality score of one table."""
    n = len(columns)
    return f"""{fences(name + '_f', source, numeric)},
{name}_c as (
  select count(*) as rows, cast({n} as bigint) as cols,
    cast(coalesce(sum({nulls(columns, 't.')}), 0) as bigint) as missing,
    count(*) - (select count(*) from (select distinct * from {source})) as duplicates,
    cast(coalesce(sum({outside_any(numeric)}::int), 0) as bigint) as outliers
  from {source} t, {name}_f f),
{name} as (
  select *, case when rows = 0 then 0.0 else greatest(0.0, least(100.0, 100.0
    - 40.0 * least(missing / (rows * cols)::double, 1.0)
    - 30.0 * least(duplicates / rows::double, 1.0)
    - 30.0 * least(outliers / rows::double, 1.0))) end as score
  from {name}_c)"""


BOTH = f"""{CLEANED},
{metrics('b', 'dirty', DIRTY_ALL, DIRTY_NUMERIC)},
{metrics('a', 'cleaned', DIRTY_ALL, DIRTY_NUMERIC)}"""


def mode_of(column, source):
    return (
        f"(select {column} from {source} where {column} is not null "
        f"group by {column} order by count(*) desc, {column} limit 1)"
    )


def summary(source, columns, types):
    """One block per column for the column summary."""
    return " union all ".join(
        f"""select {i} as o, '{c}' as "Column", '{types[c]}' as "Data Type",
  count({c}) as "Non-Null Count", count(*) - count({c}) as "Missing Count",
  round((count(*) - count({c})) * 100.0::double / count(*), 2) as "Missing %",
  count(distinct {c}) as "Unique Values" from {source}"""
        for i, c in enumerate(columns)
    )


DIRTY_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "prio": "string",
    "price": "double", "status": "string", "odate": "timestamp_ntz",
}
DOCUMENT_TYPES = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
}
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def skew(column):
    return f"(case when count({column}) >= 3 then coalesce(skewness({column}), 0) end)"


def kurt(column):
    return f"(case when count({column}) >= 4 then coalesce(kurtosis({column}), 0) end)"


def rules(source, columns, numeric, texts):
    """Suggestions of the current rules, one block per rule and column."""
    rows = f"(select count(*) from {source})"
    blocks = [
        f"""select 0 as o, '-' as "Column", printf('Duplicates (%d)', d) as "Issue Detected",
  'Remove duplicate rows' as "Suggestion",
  case when d / n::double > 0.1 then 'High' else 'Medium' end as "Severity"
  from (select count(*) as n, count(*) - (select count(*) from (select distinct * from {source})) as d
        from {source}) where d > 0"""
    ]
    for i, c in enumerate(columns, 1):
        o = i * 10
        blocks.append(
            f"""select {o}, '{c}', case when p > 50 then printf('High missing (%.1f%%)', p)
    else printf('Missing (%.1f%%)', p) end,
  case when p > 50 then 'Drop column or use KNN imputation' else 'Impute mean/median/mode' end,
  case when p > 50 then 'High' else 'Medium' end
  from (select (count(*) - count({c})) / count(*)::double * 100 as p from {source}) where p > 0"""
        )
        blocks.append(
            f"""select {o + 1}, '{c}', 'Constant values', 'Drop column', 'Low'
  from (select count(distinct {c}) as u from {source}) where u = 1"""
        )
        if c in texts:
            blocks.append(
                f"""select {o + 2}, '{c}', printf('High cardinality (%d)', u),
  'Use encoding or grouping', 'Medium'
  from (select count(distinct {c}) as u from {source}) where u > 100"""
            )
        if c in numeric:
            blocks.append(
                f"""select {o + 3}, '{c}', printf('Outliers (%.1f%%)', p), 'Cap or remove using IQR',
  case when p > 10 then 'High' else 'Medium' end
  from (select sum({outside(c)}::int) / count(*)::double * 100 as p from {source} t, rule_f f) where p > 0"""
            )
            blocks.append(
                f"""select {o + 4}, '{c}', printf('Skewed (%.2f)', s), 'Apply log transform', 'Medium'
  from (select {skew(c)} as s from {source}) where abs(s) > 1"""
            )
    body = "\n union all ".join(blocks)
    return f"""{fences('rule_f', source, numeric)},
hits as ({body}),
rule_rows as (select * from hits union all
  select 0, '-', 'No major issues', 'Dataset looks clean', 'Info' where not exists (select 1 from hits))"""


SUGGESTION = 'cast(row_number() over (order by o) - 1 as int) as position, "Column", "Issue Detected", "Suggestion", "Severity"'


def basic_rules(source, columns, numeric, texts):
    blocks = []
    for i, c in enumerate(columns):
        o = i * 10
        blocks.append(
            f"""select {o} as o, '{c}' as "Column",
  case when p > 50 then printf('High missingness (%.1f%%)', p)
    else printf('Moderate missingness (%.1f%%)', p) end as "Issue Detected",
  case when p > 50 then 'Consider dropping column or applying KNN imputation.'
    else 'Impute with mean/median (numeric) or mode (categorical).' end as "Suggestion",
  case when p > 50 then 'High' else 'Medium' end as "Severity"
  from (select (count(*) - count({c})) / count(*)::double * 100 as p from {source}) where p > 0"""
        )
        if c in texts:
            blocks.append(
                f"""select {o + 1}, '{c}', printf('High cardinality categorical (%d unique)', u),
  'Consider hashing, target encoding, or dimensionality reduction.', 'Medium'
  from (select count(distinct {c}) as u from {source}) where u > 100"""
            )
        if c in numeric:
            blocks.append(
                f"""select {o + 2}, '{c}', 'Numeric with low cardinality',
  'Review if it should be treated as categorical.', 'Low'
  from (select count(distinct {c}) as u from {source}) where u < 10"""
            )
    return " union all ".join(blocks)


# Baseline cleaning of ``dirty``, step by step.
BASELINE = f"""{DIRTY},
filled as (select o_orderkey::double as o_orderkey, o_custkey::double as o_custkey,
  coalesce(prio, {mode_of('prio', 'dirty')}) as prio,
  coalesce(price, (select avg(price) from dirty)) as price,
  coalesce(status, {mode_of('status', 'dirty')}) as status, odate from dirty),
single as (select distinct * from filled),
{fences('base_f', 'single', DIRTY_NUMERIC)},
flagged as (select t.*, {outside_any(DIRTY_NUMERIC)} as flag from single t, base_f f)"""

# The same guided by the suggestions of the catalog.
GUIDED = f"""{DIRTY},
valid as (select o_orderkey, o_custkey,
  case when lower(prio) in {INVALID_TOKENS} then null else prio end as prio,
  case when price < 0 then null else price end as price, status, odate from dirty),
filled as (select o_orderkey::double as o_orderkey,
  coalesce(prio, {mode_of('prio', 'valid')}) as prio,
  coalesce(price, (select quantile_cont(price, 0.5) from valid)) as price,
  coalesce(status, {mode_of('status', 'valid')}) as status, odate from valid),
single as (select distinct * from filled),
{fences('base_f', 'single', ('o_orderkey', 'price'))},
flagged as (select t.*, {outside_any(('o_orderkey', 'price'))} as flag from single t, base_f f),
coded as (select o_orderkey, lower(trim(prio, {BLANKS})) as prio, price, status, odate,
  dense_rank() over (order by status) - 1 as status_encoded from flagged where not flag)"""

FILLED_MEAN = f"""select o_orderkey::double as o_orderkey, o_custkey::double as o_custkey,
  coalesce(prio, {mode_of('prio', 'dirty')}) as prio,
  coalesce(price, (select avg(price) from dirty)) as price,
  coalesce(status, {mode_of('status', 'dirty')}) as status, odate from dirty"""


def change(before, after):
    d = f"({after} - {before})"
    return (
        f"case when {d} < 0 then '▼ ' || printf('%g', abs({d})::double) "
        f"when {d} > 0 then '▲ ' || printf('%g', {d}::double) else '—' end"
    )


COMPARED = (
    ("Total Rows", "b.rows", "a.rows", "cast({} as varchar)"),
    ("Total Columns", "b.cols", "a.cols", "cast({} as varchar)"),
    ("Missing Values", "b.missing", "a.missing", "cast({} as varchar)"),
    ("Duplicate Rows", "b.duplicates", "a.duplicates", "cast({} as varchar)"),
    (
        "Missing % of Cells",
        "round(b.missing / (b.rows * b.cols)::double * 100, 2)",
        "round(a.missing / (a.rows * a.cols)::double * 100, 2)",
        "printf('%.2f%%', {})",
    ),
    (
        "Duplicate % of Rows",
        "round(b.duplicates / b.rows::double * 100, 2)",
        "round(a.duplicates / a.rows::double * 100, 2)",
        "printf('%.2f%%', {})",
    ),
)


def comparison_rows(names):
    item, first, second, third = names
    parts = [
        f"select '{m}' as {item}, {f.format(x)} as {first}, {f.format(y)} as {second}, "
        f"{change(x, y)} as {third} from b, a"
        for m, x, y, f in COMPARED
    ]
    parts.append(
        "select 'Data Quality Score', printf('%.2f / 100', b.score), "
        "printf('%.2f / 100', a.score), '—' from b, a"
    )
    return " union all ".join(parts)


def arrow(d):
    return (
        f"case when {d} < 0 then '▼ ' || printf('%,d', abs({d})) "
        f"when {d} > 0 then '▲ ' || printf('%,d', {d}) else '—' end"
    )


def report_schema(source, columns, types):
    return " union all ".join(
        f"""select '{c}' as "Column", '{types[c]}' as "Type", count(*) - count({c}) as "Missing",
  printf('%.1f%%', (count(*) - count({c})) / count(*)::double * 100) as "Missing %",
  count(distinct {c}) as "Unique Values" from {source}"""
        for c in columns
    )


def histogram(source, column, bins, lines=False, version=None):
    """Every bin of one column, empty ones too."""
    extra = ", r.mean, r.median" if lines else ""
    tag = f"'{version}' as version, " if version else ""
    return f"""select {tag}'{column}' as "column", e.bin::int as bin,
  round(r.lo + e.bin * r.w, 4) as lo,
  round(case when e.bin = {bins - 1} then r.hi else r.lo + (e.bin + 1) * r.w end, 4) as hi{extra},
  coalesce(c.n, 0) as "count"
  from range({bins}) e(bin),
  (select *, (hi - lo) / {bins} as w from (select
     case when min({column}) = max({column}) then min({column}) - 0.5 else min({column}) end as lo,
     case when min({column}) = max({column}) then max({column}) + 0.5 else max({column}) end as hi,
     round(avg({column}), 4) as mean, round(quantile_cont({column}, 0.5), 4) as median from {source})) r
  left join (select least(floor(({column} - l) / ((h - l) / {bins})), {bins - 1}) as b, count(*) as n
     from {source}, (select min({column}) as l, max({column}) as h from {source})
     where {column} is not null group by 1) c on c.b = e.bin"""


def top_histograms(source, columns, top, bins, lines=False):
    """Histograms of the columns with the largest variance."""
    spread = " union all ".join(
        f"select {i} as o, '{c}' as c, var_samp({c}) as v from {source}" for i, c in enumerate(columns)
    )
    parts = " union all ".join(f"({histogram(source, c, bins, lines)})" for c in columns)
    return f"""select * from ({parts}) where "column" in
  (select c from ({spread}) order by v desc nulls last, o limit {top})"""


INSIGHT = "cast(row_number() over (order by o) - 1 as int) as position, type, title, description, round(score, 6) as score, columns"


def distribution_blocks(source, columns):
    return " union all ".join(
        f"""select {i} as o, 'distribution' as type,
  'Distribution of {c} (' || side || '-skewed)' as title,
  'Column `{c}` shows a ' || side || '-skewed distribution indicating potential outliers.' as description,
  abs(s) * 0.5 + ln(1 + v) as score, '{c}' as columns
  from (select {skew(c)} as s, var_samp({c}) as v,
    case when {skew(c)} > 0 then 'right' else 'left' end as side from {source}) where v <> 0"""
        for i, c in enumerate(columns)
    )


def correlation_blocks(source, columns, start=0):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " union all ".join(
        f"""select {start + i} as o, 'correlation' as type,
  '{a} and {b} are ' || case when r > 0 then 'positively' else 'negatively' end || ' correlated' as title,
  'Features `{a}` and `{b}` have a correlation of ' || printf('%.2f', r) || '.' as description,
  abs(r) * 2 as score, '{a},{b}' as columns
  from (select corr({a}, {b}) as r from {source}) where abs(r) >= 0.4"""
        for i, (a, b) in enumerate(pairs)
    )


def category_blocks(source, columns, full=False, start=0):
    parts = []
    for i, c in enumerate(columns):
        if full:
            title = f"case when k <= 2 then 'Category split in `{c}`' else 'Top categories in `{c}`' end"
            told = (
                f"'Column `{c}` is dominated by value `' || v || '` (' || printf('%.1f', share * 100) || "
                "'% of records). Top 5 categories together cover about ' || printf('%.1f', lead * 100) || "
                "'% of the dataset.'"
            )
        else:
            title = f"'Top categories in `{c}`'"
            told = f"'Column `{c}` is dominated by `' || v || '` (' || printf('%.1f', share * 100) || '%).'"
        parts.append(
            f"""select {start + i} as o, 'category' as type, {title} as title, {told} as description,
  lead * 0.8 as score, '{c}' as columns from (
  select max(case when place = 1 then v end) as v, max(n) / sum(n)::double as share, count(*) as k,
    sum(case when place <= 5 then n else 0 end) / sum(n)::double as lead
  from (select v, n, row_number() over (order by n desc, v) as place from
    (select coalesce(cast({c} as varchar), 'nan') as v, count(*) as n from {source} group by 1)))
  where share between 0.1 and 0.95"""
        )
    return " union all ".join(parts)


LINE_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES)
RELATED_NUMERIC = (*LINE_NUMERIC, "follow")


def trend_block(source, date, column, start=0):
    return f"""select {start} as o, 'trend' as type, 'Trend of `{column}` over `{date}`' as title,
  'Average value of `{column}` appears to be ' || case when r > 0 then 'increasing' else 'decreasing' end || '.' as description,
  abs(r) * 2 as score, '{date},{column}' as columns
  from (select corr(x, m) as r, count(*) as n from (select row_number() over (order by d) as x, m from
    (select cast({date} as date) as d, avg({column}) as m from {source} group by 1)))
  where n >= 3 and abs(r) >= 0.3"""


KNN = f"""{DIRTY},
gaps as (select distinct o_orderkey as gk, o_custkey as gc from dirty where price is null),
near as (
  select gk, gc, price, row_number() over (partition by gk, gc order by
    ((gk - o_orderkey)::double * (gk - o_orderkey) + (gc - o_custkey)::double * (gc - o_custkey)) * 3 / 2, price) as place
  from gaps, dirty where price is not null),
mean5 as (select gk, gc, avg(price) as fill from near where place <= 5 group by gk, gc)
select o_orderkey::double as o_orderkey, o_custkey::double as o_custkey,
  coalesce(prio, {mode_of('prio', 'dirty')}) as prio,
  round(coalesce(price, fill), 4) as price,
  coalesce(status, {mode_of('status', 'dirty')}) as status, cast(odate as varchar) as odate
from dirty left join mean5 on price is null and o_orderkey = gk and o_custkey = gc"""

TYPED = """with typed as (
  select o_orderkey,
    case when o_orderkey % 7 = 0 then o_custkey || 'd'
         when o_orderkey % 5 = 0 then o_custkey || '.5'
         when o_orderkey % 3 = 0 then ' ' || o_custkey || ' '
         else cast(o_custkey as varchar) end as amount,
    case when o_orderkey % 6 = 0 then null else cast(cast(o_orderdate as date) as timestamp) end as placed
  from orders)"""

REPLIES = """with items as (
  select conv_id, turn, conv_id * 10 + turn as k, concat('{"Column":"c', turn,
    '","Issue Detected":"chars ', length(text), '","Suggestion":"Drop column","Severity":" ',
    case (conv_id * 10 + turn) % 4 when 0 then 'high' when 1 then 'LOW' when 2 then 'urgent' else 'Info' end, '"}') as item
  from conversations),
replies as (
  select conv_id, turn, case k % 9
    when 0 then concat('No array here: ', item)
    when 1 then concat('Cut off [', item)
    when 2 then concat('[', item, '] or [', item, ']')
    when 3 then concat('Sure: [', '{"Column":"x","Severity":"High"}', ',', item, '] done')
    when 4 then concat('["note", 7, ', item, ']')
    else concat('[', item, ',', item, ']') end as reply
  from items),
arrays as (
  select conv_id, turn, case when instr(reply, '[') > 0 and instr(reply, ']') > 0 then
    substr(reply, instr(reply, '['), length(reply) - instr(reverse(reply), ']') + 2 - instr(reply, '[')) end as a
  from replies),
parsed as (
  select conv_id, turn, from_json(a, '["json"]') as items from arrays where a is not null and json_valid(a)),
fields as (
  select conv_id, turn, unnest(items) as f, generate_subscripts(items, 1) - 1 as position from parsed),
told as (
  select *, trim(f ->> 'Severity') as s from fields
  where json_type(f) = 'OBJECT' and json_exists(f, '$.Column') and json_exists(f, '$."Issue Detected"')
    and json_exists(f, '$.Suggestion') and json_exists(f, '$.Severity'))
select conv_id, turn, cast(position as int) as position, f ->> 'Column' as "Column",
  f ->> '$."Issue Detected"' as "Issue Detected", f ->> 'Suggestion' as "Suggestion",
  case when lower(s) in ('high', 'medium', 'low', 'info') then upper(s[1]) || lower(s[2:]) else 'Medium' end as "Severity"
from told"""


def profile_lines(source, columns, numeric, types):
    parts = []
    for i, c in enumerate(columns):
        extra = (
            f" || case when count({c}) > 2 then printf(', skewness=%.2f, has_negatives=%s', {skew(c)}, "
            f"case when count(*) filter ({c} < 0) > 0 then 'True' else 'False' end) else '' end"
            if c in numeric
            else ""
        )
        parts.append(
            f"""select {i} as o, printf('  - ''{c}'': dtype={types[c]}, missing=%.1f%%, unique_values=%d',
  (count(*) - count({c})) / count(*)::double * 100, count(distinct {c})){extra} as line from {source}"""
        )
    return " union all ".join(parts)


def column_class_rows():
    classes = (
        ("numeric", DIRTY_NUMERIC),
        ("other", ("prio", "status", "odate")),
        ("text", ("prio", "status")),
        ("date-like", ("odate",)),
        ("id-like", ("o_orderkey", "o_custkey")),
    )
    return " union all ".join(
        f"select '{k}' as class, '{c}' as \"column\", count({c}) as present from dirty"
        for k, names in classes
        for c in names
    )


def scaled(source, columns, suffix, keep, digits):
    stats = ", ".join(
        f"min({c}) as {c}_lo, max({c}) as {c}_hi, avg({c}) as {c}_m, stddev_pop({c}) as {c}_sd" for c in columns
    )
    if suffix == "_scaled":
        parts = [f"round(({c} - {c}_lo)::double / ({c}_hi - {c}_lo), {digits}) as {c}_scaled" for c in columns]
    else:
        parts = [f"round(({c} - {c}_m) / {c}_sd, {digits}) as {c}_std" for c in columns]
    return f"select {', '.join(keep)}, {', '.join(parts)} from {source}, (select {stats} from {source})"


def matrix(source, columns):
    return " union all ".join(
        f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 2) + 0.0 as r from {source}"
        for a in columns
        for b in columns
        if a != b
    ) + "".join(f" union all select '{a}', '{a}', 1.0" for a in columns)


def box(version, source):
    return f"""select '{version}' as version, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
  round(min(price) filter (price >= q1 - 1.5 * (q3 - q1)), 4) as whisker_low,
  round(max(price) filter (price <= q3 + 1.5 * (q3 - q1)), 4) as whisker_high,
  round(avg(price), 4) as mean, round(stddev_pop(price), 4) as sd
  from {source}, (select quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.5) as median,
    quantile_cont(price, 0.75) as q3 from {source}) group by q1, median, q3"""


def described(source, columns):
    return " union all ".join(
        f"""select '{c}' as "Column", count({c})::double as "count", round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as "min",
  round(quantile_cont({c}::double, 0.25), 4) as "25%", round(quantile_cont({c}::double, 0.5), 4) as "50%",
  round(quantile_cont({c}::double, 0.75), 4) as "75%", round(max({c})::double, 4) as "max",
  round({skew(c)}, 4) as skewness, round({kurt(c)}, 4) as kurtosis from {source}"""
        for c in columns
    )


STEPS_SOURCE = "'Rule-based suggestions'"
ODATE = "cast(odate as varchar) as odate"
COLUMNS = "o_orderkey, o_custkey, prio, price, status"
FOUND_TYPE = """case when count({c}) = 0 then 'double'
  when count(case when regexp_matches({c}, '^\\s*[+-]?\\d+\\s*$') then try_cast({c} as bigint) end) = count({c}) then 'bigint'
  when count(case when regexp_matches({c}, '{n}') then try_cast({c} as double) end) = count({c}) then 'double'
  when count(*) filter ({c} in ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) = count(*) then 'boolean'
  else 'string' end"""
RAW_COLUMNS = ("o_orderkey", "o_custkey", "prio", "price", "status", "odate", "even")


def without_tokens(columns):
    return ", ".join(f"case when {c} in {NULL_TOKENS} then null else {c} end as {c}" for c in columns)


ORACLE_SQL = {
    "s1_load_csv": f"""{RAW_TEXT} select k as o_orderkey, cast(o_custkey as bigint) as o_custkey,
  {without_tokens(['prio'])}, p as price, {without_tokens(['status', 'odate'])}, even = 'True' as even from raw_text""",
    "s2_null_tokens": f"""{RAW_TEXT} select {without_tokens([c for c in RAW_COLUMNS if c != 'price'])},
  case when price in {NULL_TOKENS} then null else price end as price from raw_text""",
    "s3_inferred_types": f"""{RAW_TEXT}, t as (select {without_tokens(RAW_COLUMNS)} from raw_text)
  """ + " union all ".join(
        f"select '{c}' as \"column\", {FOUND_TYPE.format(c=c, n=NUMBER)} as type from t" for c in RAW_COLUMNS
    ),
    "s4_export_csv": f"""{DIRTY} select o_orderkey, o_custkey,
  case when prio in {NULL_TOKENS} then null else prio end as prio, price, status, {ODATE} from dirty""",
    "s5_report": f"""{BOTH}
  select 'comparison' as section, * from ({comparison_rows(('item', 'first', 'second', 'third'))})
  union all select 'schema', "Column", cast("Missing" as varchar), "Missing %", cast("Unique Values" as varchar)
    from ({report_schema('cleaned', DIRTY_ALL, DIRTY_TYPES)})
  union all select 'log', '1', 'Missing: Drop', '—', 'Applied'
  union all select 'log', '2', 'Drop Duplicates', 'Dropped copies', 'Applied'""",
    "p1_column_classes": f"{DIRTY} {column_class_rows()}",
    "p2_rename": f"{DIRTY} select o_orderkey, o_custkey, prio as priority, price, status, {ODATE} from dirty",
    "p3_change_type": f"""{TYPED}, n as (select *,
    case when regexp_matches(amount, '{NUMBER}') then try_cast(trim(amount) as double) end as d from typed)
  select cast(o_orderkey as varchar) as o_orderkey, cast(placed as varchar) as placed,
    case when floor(d) = d then cast(d as bigint) end as as_int, d as as_float from n""",
    "p4_drop_column": f"{DIRTY} select {COLUMNS} from dirty",
    "p5_encode_dispatch": f"""{DIRTY}, codes as (
    select o_custkey as c, row_number() over (order by min(o_orderkey), o_custkey) - 1 as code from dirty group by o_custkey)
  select o_orderkey, o_custkey, dense_rank() over (order by coalesce(prio, 'NA')) - 1 as prio_encoded,
    code as o_custkey_encoded from dirty join codes on c = o_custkey""",
    "p6_clean_names": "select n_nationkey as nation_key, n_name as n_name, n_regionkey as region_key from nation",
    "p7_filter_by_flag": f"""{DIRTY}, {fences('q', 'dirty', DIRTY_NUMERIC)}
  select {', '.join('t.' + c for c in DIRTY_ALL[:5])}, cast(t.odate as varchar) as odate
  from dirty t, q f where not {outside_any(DIRTY_NUMERIC)}""",
    "p8_preview": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus from lineitem order by l_orderkey, l_linenumber, l_partkey limit 10""",
    "m1_basic_metrics": f"{BOTH} select rows, cols, missing, duplicates from b",
    "m2_dtype_summary": f"{DIRTY} select * exclude (o) from ({summary('dirty', DIRTY_ALL, DIRTY_TYPES)})",
    "m2_dtype_summary_documents": f"select * exclude (o) from ({summary('documents', DOCUMENT_TYPES, DOCUMENT_TYPES)})",
    "m3_quality_score": f"{BOTH} select rows, cols, missing, duplicates, outliers, round(score, 6) as score from b",
    "m4_numeric_summary": described("lineitem", ("l_linenumber", *MEASURES)),
    "m5_feature_types": f"""select "Column", "Data Type", case when "Data Type" = 'bigint' then 'Numeric'
    when "Unique Values" <= greatest(10, least(100, floor(("Non-Null Count" + "Missing Count") * 0.05))) then 'Categorical'
    else 'Text' end as "Inferred Type", "Unique Values"
  from ({summary('documents', DOCUMENT_TYPES, DOCUMENT_TYPES)})""",
    "m6_profile_text": f"""{BOTH}, lines as ({profile_lines('dirty', DIRTY_ALL, DIRTY_NUMERIC, DIRTY_TYPES)})
  select printf('Dataset shape: %d rows x 6 columns', rows) || chr(10) || chr(10) || 'Column details:' || chr(10)
    || (select string_agg(line, chr(10) order by o) from lines)
    || chr(10) || chr(10) || printf('Duplicate rows: %d', duplicates) as profile from b""",
    "m7_report_schema": f"{DIRTY} {report_schema('dirty', DIRTY_ALL, DIRTY_TYPES)}",
    "m8_quality_band": f"""{BOTH} select round(score, 4) as score,
  case when score < 40 then 'poor' when score < 70 then 'fair' else 'good' end as band from b""",
    "c1_drop_incomplete": f"""{DIRTY} select {COLUMNS}, {ODATE} from dirty
  where prio is not null and price is not null and status is not null""",
    "c2_mean_fill": f"{DIRTY} select * replace (round(price, 4) as price, cast(odate as varchar) as odate) from ({FILLED_MEAN})",
    "c3_median_fill": f"""{DIRTY} select o_orderkey::double as o_orderkey, o_custkey::double as o_custkey,
  coalesce(prio, {mode_of('prio', 'dirty')}) as prio,
  round(coalesce(price, (select quantile_cont(price, 0.5) from dirty)), 4) as price,
  coalesce(status, {mode_of('status', 'dirty')}) as status, {ODATE} from dirty""",
    "c4_mode_fill": f"""{DIRTY} select o_orderkey, o_custkey, coalesce(prio, {mode_of('prio', 'dirty')}) as prio,
  coalesce(price, {mode_of('price', 'dirty')}) as price,
  coalesce(status, {mode_of('status', 'dirty')}) as status, {ODATE} from dirty""",
    "c5_knn_impute": KNN,
    "c6_most_frequent_fill": f"""with mixed as (select o_orderkey,
    case when o_orderkey % 23 <> 0 then o_totalprice > 100000 end as big,
    case when o_orderkey % 31 <> 0 then cast(o_orderdate as date) end as day,
    case when o_orderkey % 37 <> 0 then o_orderpriority end as prio from orders)
  select o_orderkey::double as o_orderkey, coalesce(big, {mode_of('big', 'mixed')}) as big,
    cast(coalesce(day, {mode_of('day', 'mixed')}) as varchar) as day,
    coalesce(prio, {mode_of('prio', 'mixed')}) as prio from mixed""",
    "c7_drop_duplicates": f"{DIRTY} select distinct {COLUMNS}, {ODATE} from dirty",
    "c8_iqr_flags": f"""{DIRTY}, {fences('q', 'dirty', DIRTY_NUMERIC)}
  select t.o_orderkey, t.price, {outside_any(DIRTY_NUMERIC)} as is_outlier from dirty t, q f""",
    "c8_iqr_flags_events": f"""with {fences('q', 'events', ('event_id', 'user_id', 'value'))}
  select t.event_id, {outside_any(('event_id', 'user_id', 'value'))} as is_outlier from events t, q f""",
    "c9_zscore_flags": f"""{DIRTY}, z as (select {', '.join(f'avg({c}) as {c}_m, stddev_pop({c}) as {c}_s' for c in DIRTY_NUMERIC)} from dirty)
  select o_orderkey, price, {' or '.join(f'coalesce(abs(({c} - {c}_m) / {c}_s) > 3, false)' for c in DIRTY_NUMERIC)} as is_outlier
  from dirty, z""",
    "c11_remove_outliers_iqr": f"""{CLEANED}, {fences('q', 'cleaned', DIRTY_NUMERIC)}
  select {', '.join('t.' + c for c in DIRTY_ALL[:5])}, cast(t.odate as varchar) as odate
  from cleaned t, q f where not {outside_any(DIRTY_NUMERIC)}""",
    "c11_remove_outliers_zscore": f"""{DIRTY}, z as (select {', '.join(f'avg({c}) as {c}_m, stddev_pop({c}) as {c}_s' for c in DIRTY_NUMERIC)} from dirty)
  select {COLUMNS}, {ODATE} from dirty, z
  where not ({' or '.join(f'coalesce(abs(({c} - {c}_m) / {c}_s) > 2.5, false)' for c in DIRTY_NUMERIC)})""",
    "c12_invalid_tokens": f"{RAW_TEXT} select "
    + ", ".join(f"case when lower({c}) in {INVALID_TOKENS} then null else {c} end as {c}" for c in RAW_COLUMNS)
    + " from raw_text",
    "c13_negative_invalid": f"""{DIRTY} select o_orderkey, o_custkey,
  case when lower(prio) in {INVALID_TOKENS} then null else prio end as prio,
  case when price < 0 then null else price end as price, status, {ODATE} from dirty""",
    "c14_standardize_text": f"""select doc_id, n_chars,
  {', '.join(f'lower(trim({c}, {BLANKS})) as {c}' for c in ('text', 'lang', 'source'))} from documents""",
    "c15_standardize_categories": f"""{DIRTY} select o_orderkey, o_custkey,
  case lower(trim(prio)) when '1-urgent' then 'Top' when '2-high' then 'Top' when '5-low' then 'Rest' else prio end as prio,
  price, status from dirty""",
    "c16_validate_range": f"""{DIRTY} select o_orderkey,
  case when price < 20000 then 20000 when price > 300000 then 300000 else price end as price,
  case when price between 20000 and 300000 then price end as kept from dirty""",
    "c17_label_encode": f"""{DIRTY} select o_orderkey, prio,
  dense_rank() over (order by coalesce(prio, 'NA')) - 1 as prio_encoded from dirty""",
    "c18_factorize": f"""{DIRTY}, codes as (
    select price as p, row_number() over (order by min(o_orderkey), price) - 1 as code from dirty where price is not null group by price)
  select o_orderkey, price, coalesce(code, -1) as price_encoded from dirty left join codes on p = price""",
    "c19_one_hot": f"""{DIRTY} select o_orderkey, o_custkey, prio, price, {ODATE},
  coalesce(status = 'F', false) as status_F, coalesce(status = 'O', false) as status_O,
  coalesce(status = 'P', false) as status_P from dirty""",
    "c20_min_max": scaled("lineitem", LINE_NUMERIC, "_scaled", ("l_orderkey", "l_linenumber", "l_partkey"), 8),
    "c21_standard": f"{DIRTY} {scaled('dirty', DIRTY_NUMERIC, '_std', ('o_orderkey',), 6)}",
    "g1_rule_suggestions": f"""{DIRTY}, {rules('dirty', DIRTY_ALL, DIRTY_NUMERIC, ('prio', 'status'))}
  select {SUGGESTION} from rule_rows""",
    "g2_basic_rule_suggestions": f"""with hits as ({basic_rules(
        'lineitem', (*LINE_NUMERIC, 'l_returnflag', 'l_linestatus', 'l_shipdate'), LINE_NUMERIC, ('l_returnflag', 'l_linestatus'))})
  select {SUGGESTION} from hits""",
    "g3_parse_replies": REPLIES,
    "g4_generate_suggestions": f"""with {rules('events', EVENT_COLUMNS, ('event_id', 'user_id', 'value'), ('event_type', 'props'))}
  select {SUGGESTION}, 'Rule-based (Ollama unavailable)' as "Source" from rule_rows""",
    "g5_auto_clean": f"{BASELINE} select o_orderkey, o_custkey, prio, round(price, 4) as price, status, {ODATE} from flagged where not flag",
    "g5_auto_clean_steps": f"""{BASELINE}, hits as (
    select 1 as o, 'Missing values imputed (Mean for numeric / most_frequent for categorical)' as done
    union all select 2, printf('Dropped %d duplicate rows', (select count(*) from filled) - (select count(*) from single))
    union all select 3, printf('Removed %d outlier rows (IQR method)', (select count(*) from flagged where flag)))
  select o as step, done, {STEPS_SOURCE} as source from hits""",
    "g6_guided_clean": f"""{GUIDED}, m as (select {', '.join(
        f'avg({c}) as {c}_m, stddev_pop({c}) as {c}_s' for c in ('o_orderkey', 'price', 'status_encoded'))} from coded)
  select o_orderkey, prio, round(price, 4) as price, status, {ODATE}, status_encoded,
    {', '.join(f'round(({c} - {c}_m) / {c}_s, 4) as {c}_std' for c in ('o_orderkey', 'price', 'status_encoded'))} from coded, m""",
    "g6_guided_clean_steps": f"""{GUIDED}, hits as (
    select 1 as o, 'Replaced invalid/negative numeric values with missing' as done
    union all select 2, 'Dropped suggested column(s): o_custkey'
    union all select 3, 'Imputed missing values using Median'
    union all select 4, printf('Dropped %d duplicate rows', (select count(*) from filled) - (select count(*) from single))
    union all select 5, printf('Removed %d outlier rows (IQR method)', (select count(*) from flagged where flag))
    union all select 6, 'Standardized text in: prio'
    union all select 7, 'Applied label encoding on: status'
    union all select 8, 'Scaled numeric columns (Standard): 3 generated')
  select o as step, done, 'AI (Ollama phi3)' as source from hits""",
    "b1_before_after": BOTH + " " + " union all ".join(
        f"select '{m}' as \"Metric\", {x}::double as \"Before\", {y}::double as \"After\" from b, a"
        for m, x, y in zip(
            ("Rows", "Columns", "Missing Values", "Duplicate Rows", "Missing % of Cells", "Duplicate % of Rows"),
            [c[1] for c in COMPARED],
            [c[2] for c in COMPARED],
        )
    ),
    "b2_delta_metrics": f"""{BOTH} select a.rows, a.missing, a.duplicates, round(a.score, 6) as score,
  a.rows - b.rows as rows_delta, a.missing - b.missing as missing_delta,
  a.duplicates - b.duplicates as duplicates_delta, round(a.score - b.score, 6) as score_delta from a, b""",
    "b3_report_comparison": f"""{BOTH} {comparison_rows(('"Metric"', '"Before Cleaning"', '"After Cleaning"', '"Change"'))}""",
    "b4_quality_improvement": f"""{BOTH} select round(b.score, 6) as score_before, round(a.score, 6) as score_after,
  round(a.score - b.score, 6) as improvement,
  round(case when b.score > 0 then (a.score - b.score) / b.score * 100 else 0 end, 6) as improvement_pct,
  case when a.score < 40 then 'poor' when a.score < 70 then 'fair' else 'good' end as band_after from a, b""",
    "b5_kpi_deltas": f"""{BOTH} select b.rows as rows_before, a.rows as rows_after, {arrow('(a.rows - b.rows)')} as rows_change,
  b.cols as columns, b.missing as missing_before, a.missing as missing_after,
  {arrow('(a.missing - b.missing)')} as missing_change, b.duplicates - a.duplicates as duplicates_removed from a, b""",
    "i1_distributions": f"select {INSIGHT} from ({distribution_blocks('lineitem', ('l_linenumber', *MEASURES))})",
    "i2_correlations": f"{RELATED} select {INSIGHT} from ({correlation_blocks('related', RELATED_NUMERIC)})",
    "i3_categories": f"{DIRTY} select {INSIGHT} from ({category_blocks('dirty', ('prio', 'status', 'odate'))})",
    "i3_categories_documents": f"select {INSIGHT} from ({category_blocks('documents', ('text', 'lang', 'source'), full=True)})",
    "i4_trend": f"""with levels as (select ts, event_type, value + day(ts) as level from events)
  select {INSIGHT} from ({trend_block('levels', 'ts', 'level')})""",
    "i5_top_insights": f"""{RELATED}, found as (
    {distribution_blocks('related', ('l_linenumber', *MEASURES, 'follow'))}
    union all {correlation_blocks('related', RELATED_NUMERIC, 100)}
    union all {category_blocks('related', ('l_returnflag', 'l_linestatus', 'l_shipdate'), start=300)}
    union all {trend_block('related', 'l_shipdate', 'l_extendedprice', 400)}),
  picked as (select * from (select *, row_number() over (partition by type order by score desc, o) as place from found)
    where place <= 2 order by score desc, o limit 4)
  select cast(row_number() over (order by score desc, o) - 1 as int) as position, type, title, description,
    round(score, 6) as score, columns from picked""",
    "v1_missing_bar": f"{DIRTY} select * from ("
    + " union all ".join(f"select '{c}' as \"Column\", count(*) - count({c}) as \"Missing\" from dirty" for c in DIRTY_ALL)
    + ") where \"Missing\" > 0",
    "v2_missing_matrix": f"""{DIRTY}, drawn as (select * from dirty order by md5(cast(o_orderkey as varchar)) limit 200)
  select {', '.join(f'({c} is null)::int as {c}' for c in DIRTY_ALL)} from drawn""",
    "v3_correlation_matrix": f"{RELATED} {matrix('related', RELATED_NUMERIC)}",
    "v4_distributions": f"{RELATED} {top_histograms('related', RELATED_NUMERIC, 3, 30)}",
    "v4_report_distributions": f"{CLEANED} {top_histograms('cleaned', DIRTY_NUMERIC, 4, 25, lines=True)}",
    "v5_box_statistics": f"{CLEANED} {box('Before', 'dirty')} union all {box('After', 'cleaned')}",
    "v6_top_categories": """select p_type as value, count(*) as "count" from part group by 1
  order by 2 desc, 1 limit 10""",
    "v7_proportions": f"""{DIRTY}, top as (select coalesce(prio, 'nan') as value, count(*) as "count" from dirty group by 1
    order by 2 desc, 1 limit 8)
  select value, "count", round("count" / (select sum("count") from top)::double, 8) as share from top""",
    "v8_daily_series": """select cast(cast(ts as date) as varchar) as day, round(avg(value), 6) as mean
  from events group by 1""",
    "v9_scatter_sample": f"""{DIRTY} select o_custkey as x, price as y from dirty where price is not null
  order by md5(cast(o_orderkey as varchar)) limit 3000""",
    "v10_insight_distribution": histogram("events", "value", 30, lines=True),
    "v11_distribution_shift": f"""{CLEANED} ({histogram('dirty', 'price', 30, version='Before')})
  union all ({histogram('cleaned', 'price', 30, version='After')})""",
    "v12_before_after_counts": BOTH + " " + " union all ".join(
        f"select '{m}' as \"Metric\", {x}::double as \"Before\", {y}::double as \"After\" from b, a"
        for m, x, y in zip(
            ("Rows", "Columns", "Missing Values", "Duplicate Rows"), [c[1] for c in COMPARED], [c[2] for c in COMPARED]
        )
    ),
    "h1_history": f"""{BASELINE}
  select 0 as position, 'Drop Duplicates' as label, 'Manual' as source, 'Applied Drop Duplicates' as steps,
    (select count(*) from filled) as rows_before
  union all select 1, 'Text Standardization', 'Manual', 'Applied Text Standardization', (select count(*) from single)
  union all select 2, 'Outliers (IQR)', 'Manual', 'Applied Outliers (IQR)',
    (select count(*) from single)""",
    "h2_restore": f"""{BASELINE} select o_orderkey, o_custkey, prio, round(price, 4) as price, status, {ODATE} from single""",
    "h3_cleaning_log": f"""{BASELINE}, n as (select count(*) as rows_now from flagged where not flag)
  select 1 as "#", 'Drop Duplicates' as "Operation", 'Source: Manual' as "Source",
    'Applied Drop Duplicates' as "Steps Applied", 'Applied' as "Status", rows_now from n
  union all select 2, 'Text Standardization', 'Source: Manual', 'Applied Text Standardization', 'Applied', rows_now from n
  union all select 3, 'Outliers (IQR)', 'Source: Manual', 'Applied Outliers (IQR)', 'Applied', rows_now from n""",
}
