"""Operators: windows, ranks, sequences, statistics, text, joins, microstructure, kernels."""
