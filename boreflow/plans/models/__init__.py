"""Forecasters. Each runs for many wells, folds and candidates at once."""
