"""Causal measurements over streams of samples that carry a time."""
