"""Whole jobs: canonical views, feature generation, training, recommendation, registered queries."""
