"""Training-data operators: tokenisation, scoring, deduplication, filtering and archives."""
