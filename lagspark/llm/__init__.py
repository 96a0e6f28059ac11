"""Training-data operators: tokenising, mixing, extraction, search, deduplication, filtering."""
