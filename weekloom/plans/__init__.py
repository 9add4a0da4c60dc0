"""Whole runs made of the operators: cross-validation, refit, stored results."""
