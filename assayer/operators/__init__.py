"""The dataset quality metrics."""
