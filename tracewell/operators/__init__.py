"""Detection, screening, graph, risk, scoring and experiment operators."""
