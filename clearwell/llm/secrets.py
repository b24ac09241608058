"""Secrets, told from widely copied examples by who owns them.

Every candidate's value is hashed, and over the whole corpus the distinct repositories and
owners of each hash are counted. A value that many owners have is an example that was
copied around, and so is one that some owners have in many repositories; one that keeps to
its owner, and that looks random, is a live-looking credential. All work is DataFrame expressions.

Positions come from two functions that use one expression and so find the same matches:
all matches, and the text split at them. Running sums of their lengths are the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import materialize

# Kinds in the order in which they are listed, the base ones first.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Beginnings of well-known kinds of keys.
KEY = (r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}"
       r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{32,}(?![A-Za-z0-9_-])"
KINDS = ("assign", "access", "hex", "key", "opaque")
BASE_KINDS = 3
# A value with at least so many distinct owners is a copied example; so is one of several owners
# in at least so many distinct repositories.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10
# A live-looking value has at least so many different characters.
LEAST_CHARACTERS = 8


def _places(text: str, pattern: str, kind: int, keep: str, value: str) -> str:
    """SQL for an array of (start, kind, end, value) of the matches; ``value`` is SQL over a match
    ``m``, ``keep`` over such a struct ``y``."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = value.replace("PATTERN", quoted)
    # Bound once: lengths of the gaps, and the matches.
    bound = f"""named_struct('gaps', transform(split({text}, {quoted}, -1), g -> char_length(g)),
        'found', regexp_extract_all({text}, {quoted}, 0))"""
    totals = "zip_with(b.gaps, b.found, (g, m) -> g + coalesce(char_length(m), 0))"
    kept = f"""filter(zip_with(b.found, slice({_running(totals)}, 1, size(b.found)), (m, e) ->
        named_struct('start', e - char_length(m), 'kind', {kind}, 'end', e, 'value', {value})), y -> {keep})"""
    none = "cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"
    return f"if({text} rlike {quoted}, element_at(transform(array({bound}), b -> {kept}), 1), {none})"


def _running(numbers: str) -> str:
    """SQL for the running sums of an array, by doubling: each step adds what stands 1, 2, 4, ..
    places before, so n numbers take n log n additions (appending one by one would copy the list
    for each)."""
    return f"""aggregate(sequence(0, cast(ceil(log2(greatest(size({numbers}), 1))) as int)), {numbers}, (s, k) ->
        zip_with(s, slice(concat(array_repeat(0, shiftleft(1, k)), s), 1, size(s)), (x, y) -> x + y))"""


def _any_of(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """(id, owner, repository, row_key, spans) per row; row_key is null without spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repository_col).cast("string").alias("repository"), text.alias("text"))
    none = "cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)"
    assign = _places("text", ASSIGN, 0, "char_length(y.value) >= 6", "regexp_extract(m, PATTERN, 2)")
    named = _any_of("lower(text)", ["password", "passwd", "secret", "token", "apikey", "api_key"])
    parts = [
        f"if({named}, {assign}, {none})",
        f"if(contains(text, 'AKIA'), {_places('text', ACCESS, 1, 'true', 'm')}, {none})",
        _places("text", HEX, 2, "true", "m"),
        f"if({_any_of('text', ['gh', 'glpat', 'xox', 'k_live', 'AIza', 'eyJ'])}, {_places('text', KEY, 3, 'true', 'm')}, {none})",
        _places("text", OPAQUE, 4, "true", "m"),
    ]
    found = rows.withColumn("spans", F.expr(f"concat({', '.join(parts)})"))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("."),
                             F.coalesce("owner", F.lit("-")), F.lit("."), "text"), 256)
    hashed = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"),
        (F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_CHARACTERS).alias("random")))
    return found.select(
        "id", "owner", "repository", F.when(F.size("spans") > 0, key).alias("row_key"), hashed.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): distinct ones of each candidate value. A null owner or
    repository counts as one of its own."""
    each = found.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"), "owner", "repository")
    # Copies fall together within tasks first, so a frequent hash is spread by repository.
    return each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repository_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans, live, n_live, n_example) for every row.
    ``base`` has the spans of the base kinds, ``spans`` also live-looking ones of further
    kinds, ``live`` all live-looking ones; n_example counts spans of copied examples.

    Null and empty texts have none. Rows of a null id and repeated rows are answered like
    any other; a null owner is an owner of its own. Other columns are not read, whatever
    their names."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repository_col), "secret-candidates")
    held = found.where("row_key is not null")
    wide = materialize(ownership(held), "secret-owners")
    each = held.dropDuplicates(["row_key"]).select("row_key", F.explode("spans").alias("s"))
    # A frequent hash makes a large partition on this side only, which AQE splits.
    judged = each.join(wide, F.col("s.hash") == F.col("hash")).select(
        "row_key", F.struct("s.start", "s.kind", "s.end").alias("s"),
        ((F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))).alias("example"), F.col("s.random").alias("random"))
    live = ~F.col("example") & F.col("random")
    answers = judged.groupBy(F.col("row_key").alias("key")).agg(
        F.collect_list(F.when((F.col("s.kind") < BASE_KINDS) | live, F.col("s"))).alias("listed"),
        F.collect_list(F.when(live, F.col("s"))).alias("live"),
        F.count_if("example").alias("n_example"))
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    both = held.join(answers, F.col("row_key") == F.col("key")).select("id", "spans", "listed", "live", "n_example").union(
        found.where("row_key is null").select("id", "spans", empty, empty, F.lit(0).cast("bigint")))
    base = F.filter(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
                    lambda s: s["kind"] < BASE_KINDS)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    return both.select(
        "id", *counts, _joined(base).alias("base"), _joined(F.col("listed")).alias("spans"), _joined(F.col("live")).alias("live"),
        F.size("live").cast("bigint").alias("n_live"), "n_example")


def op9_secrets(spark, folder):
    return scan(spark.read.parquet(f"{folder}/documents.parquet")).select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        "spans", "live", "n_live", "n_example")
