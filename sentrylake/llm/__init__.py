"""Training-data operators: quality, deduplication, mixing, tokenising, scoring and archives."""
