"""chronofact: a PySpark engine for bitemporal statement stores."""
