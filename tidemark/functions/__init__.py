"""Column expressions; every module builds plain Spark columns."""
