"""Cross-functional retail analytics as lazy PySpark DataFrame functions.

Every public function takes DataFrames (or a :class:`~tradescope.dataset.Dataset`)
and returns a DataFrame; nothing is computed until a sink or an action runs.  The
only functions that start jobs while a plan is being built are the ones that stage an
intermediate result in the shared folder (see ``operators.staging``).
"""

from tradescope.dataset import Dataset
from tradescope.operators.filters import Filters
from tradescope.registry import TableSpec, table_specs

__all__ = ["Dataset", "Filters", "TableSpec", "table_specs"]
