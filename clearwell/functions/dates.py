"""Text dates: what a cell can mean, and which layout a column follows.

A cell is cut into a date, a time of day and a zone. Most dates mean one day; numbers such as
01/05/2024 mean two. One aggregate counts for each separator how many cells are days with the month
or with the day first; the layout that reads more cells is the column's, and cells that it cannot
read are read the other way round. Without a column (a stream, a single cell) the usual order holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import strip
from .types import ref

# Names of months and of days of the week.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
_WEEKDAY = r"^(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?[,.]? "
SEPARATORS = ("/", "-", ".")
# Separators behind which a day stands first where nothing tells.
USUALLY_DAY_FIRST = frozenset(".")
# Two-digit years from here on are of the last century.
CENTURY = 69
# Rows of a split whose cells are read in one task; a table in larger splits is dealt anew.
ROWS_PER_SPLIT = 50_000
_CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?(?: ?[ap]m)?"
_OFFSET = r"z|utc|gmt|(?:utc|gmt)?[+-][0-9]{2}(?::?[0-9]{2})?"
_TIME = rf"[ t]({_CLOCK})( ?(?:{_OFFSET})| [a-z]{{3,4}})?$"
_YEAR = "([0-9]{4}|[0-9]{2})"
_NUMBERS = rf"^([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2{_YEAR}$"
# Form of a date -> which groups are its year, month and day; 0: the first of them.
_FORMS = {
    r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$": (1, 3, 4),
    r"^([0-9]{4})([0-9]{2})([0-9]{2})$": (1, 2, 3),
    rf"^([a-z]{{3,9}})\.?[ -]?([0-9]{{1,2}})(?:, ?|[ -]){_YEAR}$": (3, 1, 2),
    rf"^([0-9]{{1,2}})[ .-]{{0,2}}([a-z]{{3,9}})\.?(?:, ?|[ -])?{_YEAR}$": (3, 2, 1),
    r"^([0-9]{4})[ -]([a-z]{3,9})\.?[ -]([0-9]{1,2})$": (1, 2, 3),
    r"^([a-z]{3,9})\.?(?:, ?|[ -])([0-9]{4})$": (2, 1, 0),
    r"^([0-9]{4})[-/.]([0-9]{1,2})$": (1, 2, 0),
    r"^([0-9]{1,2})[-/.]([0-9]{4})$": (2, 1, 0),
    r"^([0-9]{4})$": (1, 0, 0),
}
_QUARTER = "^([0-9]{4})-?q([1-4])$"


@dataclass(frozen=True)
class Layout:
    """How a column writes its dates: the separators with the day first, and whether its times are of
    several zones and therefore moved to UTC."""

    day_first: frozenset[str] = USUALLY_DAY_FIRST
    utc: bool = False


def _normal(col: Column) -> Column:
    """Lower case, single blanks, no weekday, no ordinal; times at the end and with colons."""
    text = F.lower(F.regexp_replace(strip(col), r"\s+", " "))
    text = F.regexp_replace(text, _WEEKDAY, "")
    text = F.regexp_replace(text, r"\b([0-9]{1,2})(st|nd|rd|th)\b( of)?", "$1")
    text = F.regexp_replace(text, r"^([0-9]{8})[t ]?([0-9]{2})([0-9]{2})([0-9]{2})", "$1 $2:$3:$4")
    text = F.regexp_replace(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ t]([0-9]{2})$", "$1 $2:00")
    return F.regexp_replace(text, rf"^([a-z]+ [0-9]{{1,2}}) ({_CLOCK})( (?:{_OFFSET}|[a-z]{{3,4}}))? ([0-9]{{4}})$", "$1 $4 $2$3")


def _month(text: Column) -> Column:
    """The number of a month's name (three letters or more of it), else the text."""
    names = {m[:n]: i for i, m in enumerate(MONTHS, 1) for n in (3, 4, len(m))}
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(str(i)) for i in names.values()]))
    return F.coalesce(F.try_element_at(table, text), text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used. Written out, the uses of
    uses multiply: the expression outgrows what generated code can hold and the JVM compiles."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _date(year: Column, month: Column, day: Column) -> Column:
    def full(y: Column) -> Column:
        return F.when(F.length(y) != 2, y).when(y.try_cast("int") < CENTURY, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))

    return F.concat_ws("-", _bound(year, full), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _plain_day(text: Column) -> Column:
    """The day of a date that means one only."""
    first = F.lit("1")

    def group(form: str, i: int) -> Column:
        return F.regexp_extract(text, form, i) if i else first

    found = None
    for form, (year, month, day) in _FORMS.items():
        meant = _date(group(form, year), _bound(group(form, month), _month), group(form, day))
        found = F.when(text.rlike(form), meant) if found is None else found.when(text.rlike(form), meant)
    quarter = (F.regexp_extract(text, _QUARTER, 2).try_cast("int") * 3 - 2).cast("string")
    return found.when(text.rlike(_QUARTER), _date(F.regexp_extract(text, _QUARTER, 1), quarter, first))


def _offset(zone: Column) -> Column:
    """The minutes of a zone, null without one."""
    size = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(size, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(size, 3, 2).try_cast("int"), F.lit(0))
    return F.when(zone.isin("z", "utc", "gmt"), 0).when(zone.rlike("^[+-]"), F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes))


def _parts(col: Column, *wanted: str) -> Column:
    """A struct of the ``wanted``: separator, month_first, day_first (all null unless the date is of
    numbers), plain, clock and offset (minutes, null without one)."""

    def of_day(text: Column, day: Column, numbers: Column) -> Column:
        a, b, year = (F.regexp_extract(day, _NUMBERS, i) for i in (1, 3, 4))
        zone = F.regexp_replace(F.ltrim(F.regexp_extract(text, _TIME, 2)), "^(utc|gmt)(?=[+-])", "")
        parts = {
            "separator": F.when(numbers, F.regexp_extract(day, _NUMBERS, 2)),
            "month_first": F.when(numbers, _date(year, a, b)),
            "day_first": F.when(numbers, _date(year, b, a)),
            "plain": F.when(~numbers, _plain_day(day)),
            "clock": F.regexp_replace(F.regexp_extract(text, _TIME, 1), ",", "."),
            "offset": _bound(zone, _offset),
        }
        return F.struct(*[parts[p].alias(p) for p in wanted])

    return _bound(_normal(col), lambda text: _bound(F.regexp_replace(text, _TIME, ""), lambda day: _bound(
        day.rlike(_NUMBERS), lambda numbers: of_day(text, day, numbers))))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in splits of a bounded number of rows. A cell takes many regular expressions, and a file of
    few bytes holds millions of rows, which were the work of one task. A stream stays as it is."""
    if df.isStreaming:
        return df
    splits = df.groupBy(F.spark_partition_id()).count()
    total, largest = splits.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if largest <= 2 * ROWS_PER_SPLIT:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS_PER_SPLIT)))


def layout(df: DataFrame, column: str) -> Layout:
    """The layout that reads most cells of a text column; one aggregate. The usual one for a stream."""
    if df.isStreaming:
        return Layout()
    cells = df.select(_parts(ref(column), "separator", "month_first", "day_first", "offset").alias("cell"))
    counts = [
        F.count_if((F.col("cell.separator") == s) & F.col(f"cell.{order}").isNotNull()) for s in SEPARATORS for order in ("month_first", "day_first")]
    *read, low, high = cells.agg(*counts, F.min("cell.offset"), F.max("cell.offset")).first()
    votes = dict(zip(SEPARATORS, zip(read[::2], read[1::2])))
    first = frozenset(s for s, (month, day) in votes.items() if day > month or (day == month and s in USUALLY_DAY_FIRST))
    return Layout(first, low != high)


def parsed(col: Column, how: Layout = Layout()) -> Column:
    """The time that a text means, without zone; NULL if it is no date. A time with a zone keeps its
    clock, in a column of several zones it is moved to UTC."""

    def meant(parts: Column) -> Column:
        day_first = parts["separator"].isin(*how.day_first) if how.day_first else F.lit(False)
        numbers = F.when(day_first, F.coalesce(parts["day_first"], parts["month_first"])).otherwise(
            F.coalesce(parts["month_first"], parts["day_first"]))
        day = F.coalesce(parts["plain"], numbers)
        time = _bound(F.struct(day.alias("day"), parts["clock"].alias("clock")), lambda t: _at(t["day"], t["clock"]))
        if not how.utc:
            return time
        return F.when(parts["offset"].isNull(), time).otherwise(time - F.make_dt_interval(mins=parts["offset"]))

    return _bound(_parts(col, "separator", "month_first", "day_first", "plain", "clock", "offset"), meant)


def _at(day: Column, clock: Column) -> Column:
    """``day`` with a lower-case time of day such as 13:45 or 1:45:10.5 pm, or none; NULL
    if the time is none of a day."""
    afternoon, half = F.endswith(clock, F.lit("pm")), F.endswith(clock, F.lit("m"))

    def timed(fields: Column) -> Column:
        hour = F.get(fields, F.lit(0)).try_cast("int")
        hour = F.when(~half, hour).when(hour.between(1, 12), hour % 12 + F.when(afternoon, 12).otherwise(0))
        rest = F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.get(fields, F.lit(1)), F.coalesce(F.get(fields, F.lit(2)), F.lit("00")))
        return F.when(hour.isNotNull(), F.concat_ws(" ", day.cast("string"), rest)).try_cast("timestamp_ntz")

    fields = F.split(F.regexp_replace(clock, " ?[ap]m$", ""), ":")
    return F.when(clock == "", day.cast("timestamp_ntz")).when(day.isNotNull(), _bound(fields, timed))
