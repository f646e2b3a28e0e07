"""Training-data operators (text corpora) on Spark.

Nothing else in the library imports this subpackage; it uses only the general
session helpers of the library. Each module holds one operator and states its
result for nulls, empty texts, ties, repeated rows and empty tables in its
docstring. ``queries`` holds the registered ``opN_<name>`` queries.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with the task: the package is needed on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
