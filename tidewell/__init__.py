"""tidewell: a Spark-native engine for market panels, the text around them and corpus preparation."""
