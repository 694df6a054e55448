"""Topic exploration of large text collections with PySpark DataFrames.

Rows carry their document key from source to sink; every operator takes and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
