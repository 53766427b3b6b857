"""lorekeep: a PySpark-native knowledge-corpus analytics engine.

Every operator takes and returns DataFrames.  The subpackages are
``functions`` (column builders), ``sources`` (readers and sinks),
``operators`` (DataFrame operators), ``plans`` (registered queries and their
SQL twins) and ``streaming``.
"""

__version__ = "0.1.0"
