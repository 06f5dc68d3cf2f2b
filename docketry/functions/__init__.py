"""Column expressions: text, stemming, vectors and rank metrics."""
