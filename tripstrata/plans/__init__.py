"""Whole jobs: the analytical queries, the layer builds and the end-to-end run."""
