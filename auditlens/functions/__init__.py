"""Column functions: all native Spark expressions, usable on batch and streaming frames."""
