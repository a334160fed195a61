"""Operations for training-data pipelines, each a Spark job over whole tables.

The functions that run inside tasks are shipped by value, so executors need
numpy, pyarrow and the libraries an operator names, but not this package.
"""

import importlib
import pkgutil

from pyspark import cloudpickle

for _found in pkgutil.iter_modules(__path__):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_found.name}"))
