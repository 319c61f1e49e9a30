"""sparkloom: Spark jobs for long-context training data and run analysis."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their own code, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
