"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import dialoom
from pyspark import cloudpickle

# Functions travel to the executors with the job; nothing has to be installed there.
cloudpickle.register_pickle_by_value(dialoom)
