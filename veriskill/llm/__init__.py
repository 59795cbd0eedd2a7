"""Operators of a training-data pipeline over `documents`, `pages`, `benchmark` and `labels`.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["veriskill"])
