"""Course-corpus analytics as composable Spark DataFrame operators."""
