"""Imbalanced-credit analytics on Spark: every step takes and returns a DataFrame."""

import sys

from pyspark import cloudpickle

# Executors do not have this package: functions sent to tasks carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
