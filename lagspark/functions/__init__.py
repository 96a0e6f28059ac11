"""Column functions over arrays: the arithmetic of windows and forecasts."""
