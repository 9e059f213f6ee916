"""Vector identity analytics on Spark: search, fusion, evaluation and clustering of embeddings."""
