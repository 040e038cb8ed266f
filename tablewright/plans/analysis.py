"""All sections of the analysis of one table, each as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from tablewright.operators import insights
from tablewright.operators.anomalies import anomalies
from tablewright.operators.clustering import clusters
from tablewright.operators.correlation import correlations, strong_pairs
from tablewright.operators.distribution import distribution_profile
from tablewright.operators.modeling import predictive_models
from tablewright.operators.overview import profile_summary
from tablewright.operators.profile import (
    NumericStats,
    column_counts,
    datetime_profile,
    numeric_profile,
    text_profile,
)
from tablewright.operators.quality import quality_assessment
from tablewright.operators.trend import trends
from tablewright.types import DATETIME, NUMERIC, columns_of, nan_to_null


class AnalysisPlan:
    """Sections are computed on first use; quartiles and means are learned once and shared.

    ``tie_break`` names the columns that make the order by date unique; without it there is no trend section.
    """

    def __init__(self, df: DataFrame, tie_break: Sequence[str] = (), exact: bool = True, models: bool = True):
        self.df = nan_to_null(df)
        self.tie_break = list(tie_break)
        self.exact = exact
        self.with_models = models and len(columns_of(df, NUMERIC)) >= 2

    @cached_property
    def stats(self) -> NumericStats:
        return NumericStats(self.df, exact=self.exact)

    @cached_property
    def pairs(self) -> DataFrame:
        return correlations(self.df)

    @cached_property
    def sections(self) -> dict[str, DataFrame]:
        found = {
            "summary": profile_summary(self.df, self.exact),
            "columns": column_counts(self.df, exact=self.exact),
            "numeric": numeric_profile(self.df, exact=self.exact, stats=self.stats),
            "distribution": distribution_profile(self.df, stats=self.stats),
            "text": text_profile(self.df),
            "datetime": datetime_profile(self.df),
            "correlations": self.pairs,
            "strong_pairs": strong_pairs(self.df, pairs=self.pairs),
            "anomalies": anomalies(self.df, self.exact, stats=self.stats),
            "quality": quality_assessment(self.df, self.exact),
        }
        if self.tie_break and columns_of(self.df, DATETIME):
            found["trends"] = trends(self.df, self.tie_break)
        if self.with_models:
            found["models"] = predictive_models(self.df, exact=self.exact)
            found["clusters"] = clusters(self.df)
        return found

    @cached_property
    def metrics(self) -> DataFrame:
        s = self.sections
        return insights.metrics_row(
            self.df, s["quality"], s["strong_pairs"], s["anomalies"], s.get("models"), s.get("clusters"), s.get("trends"),
            self.exact,
        )

    def insights(self) -> DataFrame:
        return insights.business_insights(self.metrics)

    def summary(self) -> DataFrame:
        return insights.analysis_summary(self.metrics)
