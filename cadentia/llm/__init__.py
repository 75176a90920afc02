"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage.  Functions that run inside tasks are pickled by
value, so executors need numpy, pandas and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
