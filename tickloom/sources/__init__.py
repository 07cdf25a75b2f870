"""Readers: driver tables as trades, books, panels and calendars, CSV ticks, and the factor store."""
