"""DataFrame operators: text preparation, representations, rankers, training sets and evaluation."""
