"""Column functions: code sequences, tokens and scores."""
