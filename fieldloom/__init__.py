"""PySpark operators for repeated-census and climate time-series analytics."""
