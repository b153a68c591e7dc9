"""labelloom: a PySpark-native engine for product-label verification at scale."""
