"""Sources of the price-bar engine."""
