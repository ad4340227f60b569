"""Evidence retrieval over text, and preparation of training corpora, as Spark jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Workers get functions by value, so they need not find the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
