"""A cleaning run with its history: apply steps, look back, restore."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import stats
from ..functions.storage import materialize, settled
from .changes import difference

# Fixed value: states kept for restoring (the older limit was 10).
MAX_SNAPSHOTS = 3


@dataclass
class Step:
    """A step taken and the table before it."""

    label: str
    before: DataFrame
    steps: list[str] = field(default_factory=list)
    source: str = "Manual"


class CleaningSession:
    """Holds the raw table, the working table and the last steps. A state whose step
    shuffles is written to the shared folder, so that later steps and looks back do not
    run it again; other states are lazy DataFrames, which cost nothing to keep.
    ``write_states`` asks for all states to be written, or none. With a ``key``, columns that tell
    rows apart, what is written for a step are its changes (see ``changes``), and a state is the raw
    table with the changes of the steps merged in."""

    def __init__(
        self, raw: DataFrame, max_snapshots: int = MAX_SNAPSHOTS, write_states: bool | None = None,
        key: list[str] | None = None,
    ):
        self.raw = raw
        self.key = key
        self.current = raw
        self.history: list[Step] = []
        self.max_snapshots = max_snapshots
        self.write_states = write_states

    def apply(
        self,
        label: str,
        table: DataFrame,
        steps: list[str] | None = None,
        source: str = "Manual",
    ) -> DataFrame:
        self.history.append(Step(label, self.current, list(steps or []), source))
        del self.history[: -self.max_snapshots]
        if self.key:
            self.current = difference(self.current, table, self.key).apply(self.current)
        elif self.write_states is None:
            self.current = settled(table, "session-state")
        else:
            self.current = materialize(table, "session-state") if self.write_states else table
        return self.current

    def restore(self, index: int) -> DataFrame:
        """Back to the state before step ``index`` (0-based); later steps are dropped."""
        self.current = self.history[index].before
        self.history = self.history[:index]
        return self.current

    def labels(self) -> list[str]:
        return [f"Step {i + 1}: {s.label}" for i, s in enumerate(self.history)]

    def history_frame(self) -> DataFrame:
        """position, label, source and steps of the kept steps."""
        return stats.small_frame(
            self.raw.sparkSession,
            [(i, s.label, s.source, s.steps) for i, s in enumerate(self.history)],
            "position int, label string, source string, steps array<string>",
        )

    def log(self, short: bool = False) -> DataFrame:
        return cleaning_log(self.raw, self.history, short)


def cleaning_log(df: DataFrame, history: list[Step], short: bool = False) -> DataFrame:
    """The cleaning log of the report; ``short`` is the older form, counted from 0."""
    spark = df.sparkSession
    if short:
        rows = [(i, s.label, "Applied") for i, s in enumerate(history)]
        return stats.small_frame(spark, rows, "`#` int, `Cleaning Step` string, `Status` string")
    rows = [
        (i, s.label[:45], f"Source: {s.source}", [t[:80] for t in s.steps] or ["—"], "Applied")
        for i, s in enumerate(history, 1)
    ]
    return stats.small_frame(
        spark,
        rows,
        "`#` int, `Operation` string, `Source` string, `Steps Applied` array<string>, `Status` string",
    )
