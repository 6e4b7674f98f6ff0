"""Keeping forecasts up to date on a stream of observations."""
