"""covalens: a Spark-first engine for positional, sequence-shaped data."""
