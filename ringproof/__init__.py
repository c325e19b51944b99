"""Evidence-graded bout reports as Spark batch jobs."""
import sys

from pyspark import cloudpickle

# Functions that tasks run are sent to the executors with the job; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
