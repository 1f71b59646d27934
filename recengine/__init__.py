"""recengine: a Spark-native analytics engine for implicit-feedback recommendation data."""
