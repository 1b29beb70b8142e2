"""wayreach: spatial accessibility analytics and corpus operators on Spark DataFrames.

The package's functions travel to Python workers by value, so executors need
only the libraries, not an installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
