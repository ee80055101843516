"""Column roles shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class ColumnSpec:
    """Names the id, label, split tag, numeric and categorical columns of a frame."""

    id: str
    label: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    split: str = "split"
    train_tag: str = "train"
    score_tag: str = "score"
    extra: dict = field(default_factory=dict)

    def with_categorical(self, *cols: str) -> "ColumnSpec":
        return ColumnSpec(self.id, self.label, self.numeric, tuple(self.categorical) + tuple(cols),
                          self.split, self.train_tag, self.score_tag, self.extra)

    def with_numeric(self, *cols: str) -> "ColumnSpec":
        return ColumnSpec(self.id, self.label, tuple(self.numeric) + tuple(cols), self.categorical,
                          self.split, self.train_tag, self.score_tag, self.extra)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.categorical)


def categorical_complement(df: DataFrame, numeric, exclude=()) -> list[str]:
    """Every column that is neither numeric nor excluded (id, label, split)."""
    skip = set(numeric) | set(exclude)
    return [c for c in df.columns if c not in skip]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    """P10: categorical list derived from the schema's string columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in set(exclude)]
