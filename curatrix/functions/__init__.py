"""Column functions on texts, labels and scores."""
