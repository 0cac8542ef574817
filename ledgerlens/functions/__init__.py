"""Column builders: pure Spark SQL expressions, no Python at run time."""
