"""Operators of the price-bar engine."""
