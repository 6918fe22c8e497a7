"""Reconciliation of keyed data held in two places, on Spark."""
