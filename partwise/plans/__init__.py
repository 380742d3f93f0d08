"""Configuration and the splitting pipeline."""
