"""tidemill: a Spark-native engine for refining semi-structured listings into a trustworthy feed."""
