"""streamgrid: regularise, align, drift-correct, merge and audit timestamped event streams on Spark."""

import sys

from pyspark import cloudpickle

from streamgrid.session import build_session

# Python functions travel to the workers by value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
