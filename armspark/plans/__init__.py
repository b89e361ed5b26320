"""Analyses composed of operators: the phases of an experiment, and the registered queries."""
