"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Its functions travel to the
executors by value, so that a worker needs no copy of the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
