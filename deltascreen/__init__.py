"""Perturbation-screen analytics as Spark DataFrame transformations over long tables."""

import sys

from pyspark import cloudpickle

# Vectorised functions travel to the executors by value, so no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
