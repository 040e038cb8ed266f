"""tablewright: get raw tables ready for analysis, and describe them, on Spark."""

from tablewright.plans.analysis import AnalysisPlan
from tablewright.plans.cleaning import CleaningOptions, CleaningPlan

__all__ = ["AnalysisPlan", "CleaningOptions", "CleaningPlan"]
