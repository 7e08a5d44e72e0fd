"""voxtide: Spark-native analytics for image sequences, sparse volumes and particle tracks."""
