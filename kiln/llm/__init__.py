"""Operators for building training corpora: duplicates, tokens, filters, audits.

Nothing else in ``kiln`` imports this package. Its worker functions travel to the executors
by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
