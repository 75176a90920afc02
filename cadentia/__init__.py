"""Batch jobs for multi-session physiological and annotation time series, as Spark DataFrames.

Functions that run inside tasks are pickled by value, so executors need numpy, pandas and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
