"""Operators that prepare text for training language models. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the task, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
