"""almanac: panel forecasting and feature analytics on Spark DataFrames.

Subpackages
-----------
sources    scans, sinks, the derived sales panel / calendar / price fixtures
functions  scalar column helpers and vectorised pandas UDFs
operators  DataFrame -> DataFrame operators and ML estimators
plans      end-to-end plans and the query catalogue (driver contract)
streaming  (none needed; see its docstring)
"""
