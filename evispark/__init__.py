"""Evidence analytics and data-processing operators on PySpark DataFrames."""
