"""Set-valued analytics and concise multi-label rule sets on PySpark DataFrames."""
