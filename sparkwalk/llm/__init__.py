"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this package imports it; ``queries.py`` registers its queries.  Functions
that run in Python workers are shipped by value, so executors need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
