"""Spark-native measurement of tracking devices: operators over streams of timestamped positions."""

__version__ = "0.1.0"

try:  # functions sent to executors travel by value, so these need not have the package installed
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # pragma: no cover
    pass
