"""Evidence mining and large-scale data preparation as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
