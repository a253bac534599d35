"""pagemill: page-corpus analytics as composable Spark DataFrame operators."""
