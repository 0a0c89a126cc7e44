"""marketloom: a PySpark-native engine for product-listing feeds and training-data preparation."""
