"""Training-data operators: quality, formatting, language, duplicates, mixing, extraction, tokens, toxicity, search."""
