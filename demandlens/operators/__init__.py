"""Analytic operators: ``DataFrame(s) + parameters -> DataFrame``, lazy."""
