"""gaugeline: data-quality checks, profiling, repair and metadata search as Spark jobs."""

from gaugeline.plans.rules import Rule
from gaugeline.operators.evaluate import evaluate, evaluate_dataset, split_rows

__all__ = ["Rule", "evaluate", "evaluate_dataset", "split_rows"]
