"""Document analytics on Spark: texts to a typed knowledge graph."""
