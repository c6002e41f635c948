"""Code-history analytics as composable Spark DataFrame transformations."""
