"""Whole runs made of the operators, and the queries over the shared test tables."""
