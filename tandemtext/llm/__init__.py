"""Operators of a training-data pipeline: cleaning, deduplication, decontamination, mixing.

Executors need no copy of this package: what its modules send to tasks travels by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
