"""Training-data operators: deduplication, tokens, filters, personal data and toxicity, each a Spark job."""
