"""Flight-telemetry and point-cloud analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's own Python functions inside the job, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
