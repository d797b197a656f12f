"""Event-log analytics on Spark: typed partitioned logs, integrity, storage planning, telemetry, delivery."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a session whose
# workers lack this folder on their path can still run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
