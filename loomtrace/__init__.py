"""Trajectory analytics for human / agent / tool event logs, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
