"""tallymill: a PySpark-native engine for tabular data quality and modelling."""
