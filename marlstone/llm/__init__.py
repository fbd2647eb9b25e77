"""Training-data operators: language, toxicity, duplicates, contamination, licences, tokens, revisits."""
