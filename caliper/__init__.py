"""caliper: specimen-measurement analytics and corpus preparation on PySpark DataFrames."""
