"""threadloom: a Spark-native analytics and search engine over archived team-chat data."""

__version__ = "0.1.0"
