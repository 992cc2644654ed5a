"""Time-series backtest and allocation analytics as lazy Spark DataFrame operators."""
