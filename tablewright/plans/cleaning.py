"""The cleaning steps in their fixed order, each of which can be switched off."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from tablewright.functions.names import schema_columns, schema_name, standardize_columns, unique_names
from tablewright.operators.combine import combine_tables
from tablewright.operators.dedupe import remove_duplicates
from tablewright.operators.missing import FilledColumns, MissingValueFiller
from tablewright.operators.outliers import CappedColumns, OutlierCapper
from tablewright.operators.privacy import MaskedColumns, PiiMasker
from tablewright.operators.typing import type_plan, typed
from tablewright.session import materialize
from tablewright.types import nan_to_null


@dataclass
class CleaningOptions:
    """``order_by`` (names as they are before renaming) decides which duplicate is kept and what a gap is filled from."""

    remove_duplicates: bool = True
    standardize_columns: bool = True
    fix_missing_values: bool = True
    cap_outliers: bool = True
    mask_pii: bool = True
    normalize_schema: bool = True
    order_by: Sequence[str] = ()
    near_duplicates: bool = True
    text_columns: Sequence[str] | None = None
    extra_keys: Sequence[str] | None = None
    exact: bool = True


@dataclass
class FittedCleaning:
    """Learned constants and the projections that apply them."""

    options: CleaningOptions
    order_by: list[str] = field(default_factory=list)
    fill: FilledColumns | None = None
    cap: CappedColumns | None = None
    mask: MaskedColumns | None = None
    types: dict[str, str] = field(default_factory=dict)

    def rename(self, df: DataFrame) -> DataFrame:
        return standardize_columns(df) if self.options.standardize_columns else df

    def dedupe(self, df: DataFrame) -> DataFrame:
        o = self.options
        if not o.remove_duplicates:
            return df
        if not o.near_duplicates or not o.order_by:
            return remove_duplicates(df)
        return remove_duplicates(df, o.order_by, text_columns=o.text_columns, extra_keys=o.extra_keys)

    def _finish(self, df: DataFrame) -> DataFrame:
        if self.cap is not None:
            df = self.cap.transform(df)
        if self.mask is not None:
            df = self.mask.transform(df)
        if self.options.normalize_schema:
            df = schema_columns(typed(df, self.types))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transform_unique(self.rename(self.dedupe(nan_to_null(df))))

    def transform_unique(self, unique: DataFrame) -> DataFrame:
        """The steps after duplicates and names."""
        return self._finish(self.fill.transform(unique) if self.fill is not None else unique)

    def transform_rows(self, df: DataFrame) -> DataFrame:
        """The steps that look at one row at a time: renaming, constant fills, caps, masks, types. Also for streams."""
        cleaned = self.rename(nan_to_null(df))
        return self._finish(self.fill.fill_constants(cleaned) if self.fill is not None else cleaned)


class CleaningPlan:
    """Duplicates, names, missing values, outliers, personal data, schema: learned by ``fit``, applied by ``transform``."""

    def __init__(self, options: CleaningOptions | None = None):
        self.options = options or CleaningOptions()

    def fit(self, df: DataFrame) -> FittedCleaning:
        fitted = FittedCleaning(self.options)
        # Several passes learn from the deduplicated rows: keep them while that lasts. Lost pieces are recomputed.
        unique = fitted.rename(fitted.dedupe(nan_to_null(df))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._learn(fitted, df, unique)
        finally:
            unique.unpersist()
        return fitted

    def _learn(self, fitted: FittedCleaning, df: DataFrame, work: DataFrame) -> None:
        o = self.options
        renamed = dict(zip(df.columns, work.columns))
        fitted.order_by = [renamed[c] for c in o.order_by]
        if o.fix_missing_values:
            fitted.fill = MissingValueFiller(fitted.order_by, o.exact).fit(work)
            work = fitted.fill.fill_constants(work)
        if o.cap_outliers:
            fitted.cap = OutlierCapper(exact=o.exact).fit(work)
            work = fitted.cap.transform(work)
        if o.mask_pii:
            fitted.mask = PiiMasker().fit(work)
            work = fitted.mask.transform(work)
        if o.normalize_schema:
            fitted.types = type_plan(work)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """As ``fit`` and ``transform`` of the same rows, which are deduplicated once and kept in the shared folder."""
        fitted = FittedCleaning(self.options)
        unique = materialize(fitted.rename(fitted.dedupe(nan_to_null(df))))
        self._learn(fitted, df, unique)
        return fitted.transform_unique(unique)

    def clean_sources(self, sources: Mapping[str, DataFrame]) -> DataFrame:
        """Clean each source on its own, then combine them."""
        cleaned, order_by = [], None
        for df in sources.values():
            fitted = FittedCleaning(self.options)
            unique = materialize(fitted.rename(fitted.dedupe(nan_to_null(df))))
            self._learn(fitted, df, unique)
            cleaned.append(fitted.transform_unique(unique))
            if fitted.order_by and order_by is None:
                final = unique_names(schema_name(c, i) for i, c in enumerate(fitted.order_by))
                order_by = final if self.options.normalize_schema else fitted.order_by
        kept = order_by if order_by and all(c in df.columns for df in cleaned for c in order_by) else None
        return combine_tables(cleaned, kept)
