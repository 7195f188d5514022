"""Fleet-scale driver and body-sensor telemetry analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions run by executors travel with the job, so the package need not be
# installed on them.
register_pickle_by_value(sys.modules[__name__])

from vitalframe.plans.detect import detect  # noqa: E402
from vitalframe.plans.respond import respond  # noqa: E402

__all__ = ["detect", "respond"]
