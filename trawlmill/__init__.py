"""Haul and sampling analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the plan, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
