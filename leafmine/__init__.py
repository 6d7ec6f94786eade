"""Document facts and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the helpers with each task, so that a session needs no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
