"""Training-data operators: deduplication, tokenising, language, quality, toxicity, secrets, archives, LM scores, leaks."""
