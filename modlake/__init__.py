"""A PySpark-native engine for content moderation analytics and corpus quality."""
