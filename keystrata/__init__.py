"""keystrata: versioned key-value analytics on PySpark DataFrames."""
