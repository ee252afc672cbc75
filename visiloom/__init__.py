"""visiloom: answer-visibility analytics as composable PySpark DataFrame operators."""
