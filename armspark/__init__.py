"""Experiment-targeting analytics as lazy Spark DataFrame operators."""

from .spec import ExperimentSpec

__all__ = ["ExperimentSpec"]
