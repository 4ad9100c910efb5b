"""Spark-first analytics over announced and reported utility interruptions.

Functions that run on executors travel with the job, so that a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
