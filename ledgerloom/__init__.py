"""ledgerloom: a PySpark-native engine for filings, long documents and the facts in them."""
