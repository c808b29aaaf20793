"""Whole runs composed of operators, and the registered queries."""
