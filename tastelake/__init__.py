"""tastelake: recommendation data work as Spark jobs over whole tables."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
