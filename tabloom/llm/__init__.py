"""Operators that prepare training text: cleaning, deduplication, decontamination, mixing, archives and shards.

Their Python functions travel to the executors by value, so that a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
