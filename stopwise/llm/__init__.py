"""Operators for preparing training data: archives, filters, tokens, near duplicates, packing.

Task code of this package is sent along with the jobs, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
