"""Streaming of the price-bar engine."""
