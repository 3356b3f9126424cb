"""Training-data operators: deduplication, quality, decontamination, search, tokenising, archives."""
