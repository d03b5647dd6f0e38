"""A PySpark engine for tabular data: composable DataFrame operators and an expression language compiled to Columns."""
