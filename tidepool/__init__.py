"""Tidepool: a PySpark-native analytics workbench.

Every operator is a plain function from DataFrame to DataFrame, or a fit step
that returns a few numbers (or a small table) plus an apply step.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside tasks travel with them, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
