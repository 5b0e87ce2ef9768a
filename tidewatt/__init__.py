"""tidewatt: Spark-native operators for regional hourly demand and weather panels."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so that they run where it isn't installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
