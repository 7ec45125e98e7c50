"""Location analytics and siting on PySpark DataFrames."""
