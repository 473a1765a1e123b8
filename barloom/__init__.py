"""barloom: price-bar analytics and backtest validation as Spark DataFrame plans."""
