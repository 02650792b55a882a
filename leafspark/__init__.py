"""Crop-imagery analytics as Spark DataFrame, Column and Structured Streaming functions."""

import sys

from pyspark import cloudpickle

# Ship our small Python helpers inside the task, so that executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
