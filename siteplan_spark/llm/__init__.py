"""Operators for preparing text corpora, and their registered queries.

Nothing else in the library imports this subpackage. Its functions travel to the executors by
value, so a cluster needs no copy of the library on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
