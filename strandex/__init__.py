"""strandex: a Spark-native engine for minimizer indexes, taxonomy roll-ups and read classification."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: these needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
