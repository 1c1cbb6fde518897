"""Vocabulary-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# executors get the few Python helpers with the task, so nothing is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
