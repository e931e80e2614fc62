"""Training-data operators: cleaning, deduplication, language models, search and packing."""
