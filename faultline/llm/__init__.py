"""Operators for preparing training corpora, and their queries.

Functions that run in Python workers are shipped whole with the job, so that
executors need neither this package nor the driver's search path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
