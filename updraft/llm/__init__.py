"""Training-data operators: filtering, deduplication, tokens, mixing and chat text."""
