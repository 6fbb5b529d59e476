"""Operators for training-data pipelines over a table of documents.

Functions that run inside tasks travel by value, so executors need no copy of
this package on their own paths.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
