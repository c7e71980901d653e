"""brindle: composable DataFrame operators for PySpark."""
