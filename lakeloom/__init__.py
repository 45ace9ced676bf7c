"""A Spark-native engine for keyed documents: tables with operation logs, append-only logs, indexes kept up to date, one-shot and live queries."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors don't need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lakeloom.operators.changes import ChangeStream, Pipe  # noqa: E402
from lakeloom.operators.mutators import compile_update  # noqa: E402
from lakeloom.operators.predicates import Range  # noqa: E402
from lakeloom.sources.collection import Log, Table  # noqa: E402
from lakeloom.sources.database import Database  # noqa: E402
from lakeloom.streaming.index import Index  # noqa: E402
from lakeloom.streaming.profiler import profile_log  # noqa: E402

__all__ = ["ChangeStream", "Database", "Index", "Log", "Pipe", "Range", "Table", "compile_update", "profile_log"]
