"""Panel, feature, forecast, hierarchy, metric and analysis operators."""
