"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import evidex

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(evidex)
