"""Corpus operators for training-data pipelines (near-dedup, mixing, packing, filters, archives, search).

Nothing else in the library imports this subpackage. Functions that run inside
Python tasks are shipped with the job (pickled by value), so executors need only
numpy, pyarrow and the codec modules, not this package.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
