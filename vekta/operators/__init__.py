"""Vector-search and evaluation operators (DataFrame in, DataFrame out)."""
