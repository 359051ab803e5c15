"""Entity survival analytics on Spark."""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks by value: executors then need only the public libraries.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
