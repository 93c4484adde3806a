"""helixmill: a PySpark-native engine for genomic-edit tables and training-data text."""
