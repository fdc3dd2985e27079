"""simvane: dense-vector analytics and corpus operators on PySpark DataFrames."""
