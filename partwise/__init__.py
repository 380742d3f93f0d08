"""Leakage-aware dataset splitting on Spark."""
