"""loomline: a PySpark-native engine for curating and evaluating text-and-audio corpora."""
