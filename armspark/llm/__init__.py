"""Operators for large text corpora. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# The functions of tasks travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
