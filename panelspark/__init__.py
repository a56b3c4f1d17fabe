"""PySpark-native analytics on panels, series, forecasts and classified maps."""
