"""iolens: a PySpark-native analytics engine for performance-trace events.

The package is shipped to Python workers by value, so that executors need no
copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
