"""PySpark-native analytics over catalogues of tracked objects whose sources disagree."""
