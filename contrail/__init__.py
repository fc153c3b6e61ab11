"""contrail: Spark-native analytics over aircraft position traces."""
