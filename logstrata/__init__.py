"""Evidence-oriented log and text analytics on PySpark DataFrames."""
