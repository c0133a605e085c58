"""Operators over panels, intervals, events, portfolios and series."""
