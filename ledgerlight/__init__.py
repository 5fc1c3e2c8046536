"""PySpark operators for governing AI-agent tool calls, for anti-money-laundering analysis and for training corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
