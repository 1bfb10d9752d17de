"""Operators for large text corpora; nothing else in the library imports this subpackage.

Functions that run in Python workers travel with the job, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
