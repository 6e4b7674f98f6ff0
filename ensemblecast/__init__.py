"""Bootstrap-aggregated forecasting and training-data operators on Spark."""
