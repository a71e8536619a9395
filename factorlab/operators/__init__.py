"""Operators: matrix preparation, fitting, criteria, prediction, resampling, inference, time series, description."""
