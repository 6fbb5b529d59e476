"""Keyword search and curation over a catalogue of media text, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
