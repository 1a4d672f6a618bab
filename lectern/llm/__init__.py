"""Training-data operators: scoring, deduplication, formatting, tokens, media, language."""
