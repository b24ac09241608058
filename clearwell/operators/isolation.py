"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) as Spark jobs.

A bounded uniform sample feeds the trees, which grow in parallel tasks; the nodes
(a few hundred per tree, whatever the table) are shipped to the scoring tasks.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..functions.packaging import ship
from ..functions.storage import materialize
from ..functions.types import numeric_columns, ref

# Forest size, rows per tree and seed.
TREES = 200
TREE_ROWS = 256
SEED = 42
# Rows of a split that are scored in one task; a table in larger or fewer splits is dealt anew.
ROWS_PER_SPLIT = 500_000
EULER_GAMMA = 0.5772156649015329


def expected_depth(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Nodes as (feature, cut, left, right, path). A leaf points to itself; its ``path``
    is its depth plus the expected rest."""
    nodes = []
    queue = [(rows, 0, None)]
    while queue:
        part, depth, parent = queue.pop()
        at = len(nodes)
        if parent is not None:
            owner, side = parent
            nodes[owner][side] = at
        low, high = part.min(axis=0), part.max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= max_depth or len(part) <= 1 or not len(spread):
            nodes.append([0, np.inf, at, at, depth + float(expected_depth(len(part)))])
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes.append([feature, cut, -1, -1, 0.0])
        queue.append((part[goes_left], depth + 1, (at, 2)))
        queue.append((part[~goes_left], depth + 1, (at, 3)))
    return nodes


def _mean_path(points: np.ndarray, trees, max_depth: int) -> np.ndarray:
    count = len(points)
    flat, rows = np.asfortranarray(points).ravel(order="F"), np.arange(count)
    total = np.zeros(count)
    for feature, cut, left, right, path in trees:
        offset, child = feature * count, np.column_stack([left, right]).ravel()
        # All rows are at the root at first: its column as it is.
        at = child.take((points[:, feature[0]] > cut[0]).astype(np.int64))
        for _ in range(max_depth - 1):
            value = flat.take(offset.take(at) + rows)
            at = child.take(2 * at + (value > cut.take(at)))
        total += path.take(at)
    return total / max(len(trees), 1)


@dataclass
class IsolationModel:
    columns: list[str]
    trees: list
    tree_rows: int
    max_depth: int = 0
    threshold: float | None = None
    seen: int = 0  # complete rows of the table it was grown on
    largest: int = 0  # of these in its largest split

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Anomaly score in 0..1; NULL for rows with a NULL feature."""
        if not self.trees:
            return df.withColumn(name, F.lit(None).cast("double"))
        trees = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = float(expected_depth(self.tree_rows)) or 1.0
        depth = self.max_depth

        @F.pandas_udf("double")
        def score(*features: pd.Series) -> pd.Series:
            points = np.column_stack([f.to_numpy(dtype=float) for f in features])
            known = ~np.isnan(points).any(axis=1)
            out = np.full(len(points), np.nan)
            out[known] = 2.0 ** (-_mean_path(points[known], trees.value, depth) / norm)
            return pd.Series(out)  # NaN arrives in Spark as NULL

        ship(df.sparkSession)
        return df.withColumn(name, score(*[ref(c).cast("double") for c in self.columns]))

    def set_threshold(self, scored: DataFrame, name: str, contamination: float) -> None:
        """So that the ``contamination`` share with the highest scores lies above."""
        self.threshold = stats.quantiles(scored, [name], [1.0 - contamination])[name][0]

    def above(self, score) -> F.Column:
        if self.threshold is None:
            return F.lit(False)
        return F.coalesce(score > self.threshold, F.lit(False))

    def transform(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        scored = self.score(df, "__score")
        return scored.withColumn(name, self.above(F.col("__score"))).drop("__score")


def grow_forest(
    df: DataFrame,
    columns: list[str] | None = None,
    key: list[str] | None = None,
    trees: int = TREES,
    seed: int = SEED,
    tree_rows: int = TREE_ROWS,
) -> IsolationModel:
    """Grow the forest, each tree on ``tree_rows`` rows drawn for it without replacement,
    as the algorithm has it. ``key`` makes the draw independent of the file layout; equal
    rows of one key are drawn by their place.

    Every row is dealt to few trees by hash, so that each gets some more rows than it
    needs; in a table too small for that, to all of them. Trees grow in parallel groups of
    bounded size, and only their nodes reach the driver."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return IsolationModel([], [], 0)
    features = [stats.as_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)]
    names = [f"x{i}" for i in range(len(columns))]
    draw = F.xxhash64(*map(ref, key), F.lit(seed)) if key else F.xxhash64(F.rand(seed))
    rows = df.select(draw.alias("draw"), *features).na.drop("any", subset=names)
    splits = rows.groupBy(F.spark_partition_id()).count()
    total, largest = splits.agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if not total:
        return IsolationModel(columns, [], 0)
    tree_rows = min(tree_rows, total)
    max_depth = int(np.ceil(np.log2(max(tree_rows, 2))))
    # Rows wanted per tree: twice what it takes, which a draw by hash gives all but surely.
    share = min(1.0, 2.0 * tree_rows / total + 16.0 / total)
    lots = 1 << 30
    lot = F.pmod(F.xxhash64("draw", "tree"), F.lit(lots))
    if share * trees < 1:
        # A row is wanted by one tree at most: its hash says by which.
        place = F.pmod(F.xxhash64("draw"), F.lit(lots))
        dealt = rows.withColumn("place", place).where(F.col("place") < int(share * trees * lots)).withColumn(
            "tree", (F.col("place") % trees).cast("bigint"))
    else:
        dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint")))).where(
            lot < int(share * lots))
    spark = df.sparkSession
    ship(spark)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        part = part.sort_values(["lot", *names], kind="stable").head(tree_rows)
        nodes = grow_tree(part[names].to_numpy(dtype=float), np.random.default_rng(seed + tree), max_depth)
        frame = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        frame.insert(0, "node", np.arange(len(frame)))
        frame.insert(0, "tree", tree)
        return frame

    grown = (
        dealt.select("tree", lot.alias("lot"), *names)
        .groupBy("tree")
        .applyInPandas(
            grow,
            "tree bigint, node bigint, feature bigint, cut double, left bigint, right bigint, path double",
        )
        .toPandas()  # at most trees * 2 * tree_rows nodes
        .sort_values(["tree", "node"])
    )
    forest = [
        tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        for _, t in grown.groupby("tree")
    ]
    return IsolationModel(columns, forest, tree_rows, max_depth, seen=total, largest=largest)


def fit_isolation_forest(
    df: DataFrame, contamination: float = 0.05, **options
) -> IsolationModel:
    """Forest and threshold, for use on this or another table."""
    model = grow_forest(df, **options)
    if model.trees:
        model.set_threshold(model.score(df, "score").select("score"), "score", contamination)
    return model


def _splits(seen: int, largest: int, cores: int) -> int:
    """In how many splits a table is scored, 0 if those it has will do: none so large that a few tasks
    have the work, whatever the files."""
    if seen >= cores * ROWS_PER_SPLIT and largest <= 2 * ROWS_PER_SPLIT:
        return 0
    return max(cores, -(-seen // ROWS_PER_SPLIT))


def flag_anomalies(
    df: DataFrame, contamination: float = 0.05, name: str = "is_outlier", **options
) -> DataFrame:
    """The table with its flag. Scoring costs far more than writing a row, so the scored
    table is written once and read for both the threshold and the flag."""
    model = grow_forest(df, **options)
    if not model.trees:
        return df.withColumn(name, F.lit(False))
    splits = _splits(model.seen, model.largest, df.sparkSession.sparkContext.defaultParallelism)
    if splits:
        df = df.repartition(splits)
    scored = materialize(model.score(df, "__score"), "anomaly-scores")
    model.set_threshold(scored, "__score", contamination)
    return scored.withColumn(name, model.above(F.col("__score"))).drop("__score")


def detect_outliers_isolation_forest(
    df: DataFrame, contamination: float = 0.05, **options
) -> tuple[DataFrame, dict]:
    """The table with ``is_outlier``, and how many rows it flags."""
    flagged = flag_anomalies(df, contamination, **options)
    row = flagged.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_outlier").alias("flagged")
    ).first()
    share = row["flagged"] / row["rows"] if row["rows"] else 0.0
    return flagged, {"n_anomalies": row["flagged"], "anomaly_ratio": share}
