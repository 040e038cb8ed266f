"""Finding and masking personal data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.patterns import PII_PATTERNS
from tablewright.operators.longform import cells, one_row_per_column, ratio
from tablewright.types import TEXT, col, columns_of, require_columns

GATE = 0.1

# The most specific pattern first, so that a card number is not taken for a phone number.
SPECIFIC_ORDER = ("credit_card", "ssn", "email", "ip_address", "phone")
LISTED_ORDER = tuple(PII_PATTERNS)

_KEPT_DIGITS = {"phone": "XXX-XXX-", "ssn": "XXX-XX-", "credit_card": "XXXX-XXXX-XXXX-"}


def _label(kind: str) -> str:
    return f"MASKED_{kind.upper()}"


def mask_cell(value: Column, kind: str) -> Column:
    """Mask the whole cell: keep the mail domain or the last four digits, otherwise a label."""
    if kind == "email":
        at = F.locate("@", value)
        user = F.substring(value, F.lit(1), at - 1)
        hidden = F.when(
            F.length(user) > 1, F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), F.length(user) - 1))
        ).otherwise("*")
        masked = F.when(at > 0, F.concat(hidden, F.substring(value, at, F.length(value))))
    elif kind in _KEPT_DIGITS:
        digits = F.regexp_replace(value, r"\D", "")
        masked = F.when(F.length(digits) >= 4, F.concat(F.lit(_KEPT_DIGITS[kind]), F.right(digits, F.lit(4))))
    else:
        masked = F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.coalesce(masked, F.lit(_label(kind))))


def mask_spans(value: Column, kinds: Sequence[str] = SPECIFIC_ORDER, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Replace only the matched pieces of a text by their label; the rest of the text stays."""
    for kind in kinds:
        value = F.regexp_replace(value, patterns[kind], _label(kind))
    return value


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None, patterns: Mapping[str, str] = PII_PATTERNS) -> DataFrame:
    """``(cid, column, pii_type, non_null, matches, share)`` over all rows of the text columns, in one pass."""
    names = [c for c in (columns or columns_of(df, TEXT)) if c in columns_of(df, TEXT)]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "cid int, column string, pii_type string, non_null bigint, matches bigint, share double"
        )
    texts = cells(df, names, {"s": lambda f: col(f.name)})
    counted = texts.groupBy("cid").agg(
        F.count("s").alias("non_null"), *[F.count_if(F.col("s").rlike(p)).alias(kind) for kind, p in patterns.items()]
    )
    full = one_row_per_column(df, names, counted)
    entries = [F.struct(F.lit(kind).alias("pii_type"), F.col(kind).alias("matches")) for kind in patterns]
    long = full.select("cid", "column", "non_null", F.explode(F.array(*entries)).alias("e"))
    return long.select(
        "cid",
        "column",
        "e.pii_type",
        F.coalesce("non_null", F.lit(0)).cast("bigint").alias("non_null"),
        F.coalesce("e.matches", F.lit(0)).cast("bigint").alias("matches"),
        ratio(F.col("e.matches"), F.col("non_null")).alias("share"),
    )


@dataclass
class MaskedColumns:
    """Which masks apply to which column, in order. A pure projection; runs on batches and streams."""

    plan: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        def masked(name: str) -> Column:
            value = col(name)
            for kind in self.plan.get(name, []):
                value = mask_cell(value, kind)
            return value.alias(name)

        return df.select(*[masked(c) for c in df.columns])


class PiiMasker:
    """Flags a text column as personal data when more than a tenth of its values match a pattern.

    ``order="specific"``: all values are looked at, each column gets the first matching type, most specific first.
    ``order="listed"``: types are tried as listed, each on the column as masked so far, so that several can apply.
    ``sample`` with ``order_by`` looks at the first values only, in that order.
    """

    def __init__(self, order: str = "specific", sample: int | None = None, order_by: Sequence[str] = ()):
        if order not in ("specific", "listed"):
            raise ValueError("order is 'specific' or 'listed'")
        if sample is not None and not order_by:
            raise ValueError("a sample of the first values needs order_by columns")
        self.order, self.sample, self.order_by = order, sample, list(order_by)

    def _flagged(self, df: DataFrame, names: Sequence[str], kinds: Sequence[str]) -> dict[str, set[str]]:
        patterns = {k: PII_PATTERNS[k] for k in kinds}
        if self.sample is None:
            rows = pii_scan(df, names, patterns).where(F.col("share") > GATE).collect()
        else:
            require_columns(df, self.order_by)
            rows = []
            for name in names:  # one top-n per column
                first = df.where(col(name).isNotNull()).orderBy(*map(col, self.order_by)).limit(self.sample)
                rows += pii_scan(first, [name], patterns).where(F.col("share") > GATE).collect()
        found: dict[str, set[str]] = {}
        for row in rows:
            found.setdefault(row["column"], set()).add(row["pii_type"])
        return found

    def fit(self, df: DataFrame) -> MaskedColumns:
        names = columns_of(df, TEXT)
        if not names:
            return MaskedColumns()
        if self.order == "specific":
            found = self._flagged(df, names, LISTED_ORDER)
            return MaskedColumns({n: [next(k for k in SPECIFIC_ORDER if k in kinds)] for n, kinds in found.items()})
        result = MaskedColumns()
        for kind in LISTED_ORDER:
            for name in self._flagged(result.transform(df), names, [kind]):
                result.plan.setdefault(name, []).append(kind)
        return result
