"""A Spark-native record intelligence engine: DataFrame transforms and Column functions."""
