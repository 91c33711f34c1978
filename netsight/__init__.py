"""Network-traffic security analytics as PySpark DataFrame operators."""
