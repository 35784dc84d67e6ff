"""Training-data operators: deduplication, quality, packing, tokens, languages, personal data, archives."""
