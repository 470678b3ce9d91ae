"""Book text, segment and job analytics on PySpark DataFrames."""
