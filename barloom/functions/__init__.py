"""Functions of the price-bar engine."""
