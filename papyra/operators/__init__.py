"""Search, facets, rule analysis and display operators."""
