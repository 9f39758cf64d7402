"""PySpark-native analytics for urban heat data.

The package declares logical plans with the DataFrame API; Catalyst and
Tungsten choose the physical strategy. Python kernels are Arrow-batched and
used only where built-in expressions cannot state the semantics.
"""

__version__ = "0.1.0"
