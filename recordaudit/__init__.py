"""recordaudit: audit large corpora of generated text records on Spark.

DataFrame-in / DataFrame-out operators with column names as parameters:
prompt grids and batch completion, age / gender cleaners, banded and
categorical profiles, field coverage and gazetteer matching, 2x2 chi-square
against real counts, length and token summaries, positional and keyed
alignment of tables.
"""

import sys as _sys

try:  # ship our functions by value to Python workers (no sys.path needed there)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
