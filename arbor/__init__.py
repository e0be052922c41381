"""arbor: a PySpark-native engine over source trees, call graphs and text corpora."""
