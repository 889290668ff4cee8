"""PySpark-native engine for multilingual lexical and text analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
