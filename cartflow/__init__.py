"""cartflow: reorder prediction and basket analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame (or a
``pyspark.ml`` stage).  Nothing is computed until an action runs, so
Catalyst sees whole plans and prunes, pushes down and reuses shuffles.
"""

import sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (mapInPandas
# helpers) are shipped by value, so executors do not need the package
# installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older pickler: ship the package with addPyFile
    pass
