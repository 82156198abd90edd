"""Whole flows built from the operators, and the queries run over the driver's tables."""
