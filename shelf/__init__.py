"""shelf: a text catalogue as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from shelf.session import apply_settings, local_session

# functions that run inside tasks travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["apply_settings", "local_session"]
