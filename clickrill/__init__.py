"""clickrill: clickstream analytics as composable Spark DataFrame functions."""
