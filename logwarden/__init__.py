"""Security-log analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame, so the same
call works on a batch table and, unless its docstring says otherwise, on a
Structured Streaming source.
"""

__version__ = "0.1.0"
