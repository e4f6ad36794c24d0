"""Raw records to typed columns by a declared mapping; records that don't fit go to quarantine with their reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A target column: where it comes from (SQL expression or Column), its type (DDL), whether it may be null, and a
    check of its value with the words to say when it fails."""

    source: str | Column
    type: str
    required: bool = False
    check: Callable[[Column], Column] | None = None
    told: str = "fails its check"

    def raw(self) -> Column:
        return F.expr(self.source) if isinstance(self.source, str) else self.source


def _typed(df: DataFrame, mapping: dict[str, Field]) -> DataFrame:
    """df as struct `record`, the target columns as struct `typed`, and `reasons`, an array of text."""
    raw = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.struct(*[f.raw().alias(name) for name, f in mapping.items()]).alias("raw"))
    kinds = {f.name: f.dataType for f in raw.schema["raw"].dataType.fields}
    texts = {name for name, kind in kinds.items() if kind.simpleString() == "string"}
    # only text may fail to be read; other types are cast as the mapping says, and what doesn't fit is null as well
    cast = lambda name, f: (F.nullif(F.trim(F.col(f"raw.`{name}`")), F.lit("")) if name in texts and f.type != "string" else F.col(f"raw.`{name}`")).try_cast(f.type)
    out = raw.withColumn("typed", F.struct(*[cast(name, f).alias(name) for name, f in mapping.items()]))
    reasons = []
    for name, f in mapping.items():
        value, told = F.col(f"typed.`{name}`"), F.col(f"raw.`{name}`")
        blank = told.isNull() | (F.trim(told.cast("string")) == "" if name in texts and f.type != "string" else F.lit(False))
        reasons.append(F.when(~blank & value.isNull(), f"{name}: not {f.type}"))
        if f.required:
            reasons.append(F.when(blank, f"{name}: missing"))
        if f.check:
            reasons.append(F.when(value.isNotNull() & ~F.coalesce(f.check(value), F.lit(False)), f"{name}: {f.told}"))
    return out.select("record", "typed", F.array_compact(F.array(*reasons)).alias("reasons"))


def normalize(df: DataFrame, mapping: dict[str, Field]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the records of df that fit as target columns, and the others as they came with a column
    `reasons`. Every record is in one of the two, once. Text that can't be read as the type of its target is a reason, as
    is a missing required value or a failed check; empty text is missing where the target isn't text. Both results come
    from one plan without a shuffle; store what _typed() gives if reading df twice is dear."""
    every = _typed(df, mapping)
    return every.where(F.size("reasons") == 0).select("typed.*"), every.where(F.size("reasons") > 0).select("record.*", "reasons")
