"""loomtext: text analytics and natural-language processing as DataFrame plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions that run in Python workers travel with their code: executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
