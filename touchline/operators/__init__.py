"""Operators: events, passes, formulas, encoders, statistics, metrics, models, density, runs."""
