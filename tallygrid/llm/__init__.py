"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions travel to the workers whole, so these need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
