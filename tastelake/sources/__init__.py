"""Scans, sinks, the feature-view catalog and saved models."""
