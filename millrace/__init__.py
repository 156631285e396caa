"""millrace: language-model data preparation, analysis and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from millrace.session import build_session

# Python functions of this package travel to the executors whole, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
