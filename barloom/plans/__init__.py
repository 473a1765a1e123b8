"""Plans of the price-bar engine."""
