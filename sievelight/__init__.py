"""sievelight: a PySpark-native engine that turns raw web pages into clean text."""
