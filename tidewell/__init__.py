"""A Spark-native analytics library for prompt, feedback and training data."""
