"""Sentence-pair corpora on Spark: read, clean, augment, split, score, evaluate."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks are sent whole, so the workers need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
