"""procuris: supplier risk and spend analytics as composable Spark DataFrame operators."""
