"""PySpark-native lexicon search and text analytics."""
