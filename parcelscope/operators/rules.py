"""Rule sets as one array column: every rule is a condition and a struct of texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from parcelscope.session import apart


@dataclass
class RuleSet:
    """Ordered rules over the columns of one row; evaluated without any join."""

    fields: Sequence[str]
    rules: list[tuple[Column, list[Column], Column | float]] = field(default_factory=list)

    def add(self, when: Column, *values: str | bool | Column, weight: Column | float = 0.0) -> Column:
        """Add a rule; heavier ones come first, equal ones in the order added."""
        cells = [v if isinstance(v, Column) else F.lit(v) for v in values]
        when = F.coalesce(when, F.lit(False))
        self.rules.append((when, cells, weight if isinstance(weight, Column) else float(weight)))
        return when

    def flagged(self, df: DataFrame, prefix: str = "_rule") -> DataFrame:
        """Work the conditions out as flags of the row, ``prefix`` and a number; the rules read these from now on."""
        rows = apart(df, **{f"{prefix}{i}": when for i, (when, _, _) in enumerate(self.rules)})
        self.rules = [(F.col(f"{prefix}{i}"), cells, weight) for i, (_, cells, weight) in enumerate(self.rules)]
        return rows

    def hits(self) -> Column:
        """Array of structs of the rules that hold."""
        items = []
        for i, (when, cells, weight) in enumerate(self.rules):
            named = [c.alias(n) for c, n in zip(cells, self.fields, strict=True)]
            order = -weight if isinstance(weight, Column) else F.lit(-weight)
            items.append((weight, F.when(when, F.struct(order.alias("order"), F.lit(i).alias("ordinal"), *named))))
        varying = any(isinstance(weight, Column) for weight, _ in items)
        if not varying:  # their order is known; equal ones stay as added
            items.sort(key=lambda item: -item[0])
        held = F.array_compact(F.array(*[item for _, item in items]))
        return F.sort_array(held) if varying else held

    def ranked(self) -> list[tuple[Column, list[Column], float]]:
        """The rules from the heaviest on, as ``hits`` orders them; for weights that are numbers."""
        return sorted(self.rules, key=lambda rule: -rule[2])

    def load(self) -> Column:
        """The weights of the rules that hold, added up in their order."""
        total = F.lit(0.0)
        for when, _, weight in self.ranked():
            total = total + F.when(when, weight).otherwise(0.0)
        return total

    def any_of(self, name: str, value: str) -> Column:
        """Whether a rule holds whose field is this value."""
        at = list(self.fields).index(name)
        return F.coalesce(*[F.when(when & (cells[at] == value), True) for when, cells, _ in self.rules], F.lit(False))

    def first(self, name: str) -> Column:
        """A field of the first rule that holds, NULL if none does."""
        at = list(self.fields).index(name)
        return F.coalesce(*[F.when(when, cells[at]) for when, cells, _ in self.ranked()])


def exploded(df: DataFrame, items: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Long form of a rule array: one row per hit, ranked."""
    fields = [f for f in df.schema[items].dataType.elementType.fieldNames() if f not in ("order", "ordinal")]
    # the outer form, as the other one adds a size test of its own, which repeats every step behind the array
    rows = df.select(*keys, F.posexplode_outer(items).alias("p", "i")).where(F.col("p").isNotNull())
    return rows.select(*keys, (F.col("p") + 1).alias("rank"), *[f"i.{f}" for f in fields])
