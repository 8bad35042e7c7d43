"""graphfold: fold many property graphs into one, as Spark DataFrame operations."""
