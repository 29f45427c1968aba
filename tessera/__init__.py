"""Tessera: a Spark-first engine for annotated function graphs and corpora."""
