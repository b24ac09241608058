"""Table profiling and cleaning as Spark DataFrame plans.

Every cleaning step is a small fitted model (a handful of literals per column)
plus a stateless ``transform``; nothing row-sized ever reaches the driver.
"""

from .functions import stats, types  # noqa: F401
from .operators import (  # noqa: F401
    columns,
    dedupe,
    encode,
    invalid,
    isolation,
    knn,
    missing,
    outliers,
    ranges,
    scale,
    text,
)
from .plans import chartdata, compare, insights, profile, suggest  # noqa: F401
from .plans.session import CleaningSession  # noqa: F401
from .sources.reader import load_dataset  # noqa: F401
from .sources.writer import export_csv, write_report  # noqa: F401
