"""Rules as data, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _texts(value) -> list[str]:
    return [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


#: Operator -> column of (column, value). Comparisons with null are false, negations of them true.
OPERATORS = {
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
    "is_empty": lambda c, v: F.trim(_text(c)) == "",
    "is_not_empty": lambda c, v: F.trim(_text(c)) != "",
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "greater": lambda c, v: c > v,
    "greater_equal": lambda c, v: c >= v,
    "less": lambda c, v: c < v,
    "less_equal": lambda c, v: c <= v,
    "between": lambda c, v: c.between(*v),
    "contains_any": lambda c, v: F.exists(F.array(*map(F.lit, _texts(v))), lambda w: _text(c).contains(w)),
    "contains_all": lambda c, v: F.forall(F.array(*map(F.lit, _texts(v))), lambda w: _text(c).contains(w)),
    "not_contains": lambda c, v: ~F.exists(F.array(*map(F.lit, _texts(v))), lambda w: _text(c).contains(w)),
    "matches": lambda c, v: c.rlike(v),
    "in_list": lambda c, v: c.isin(list(v)),
    "not_in_list": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
}


@dataclass(frozen=True)
class Test:
    """A column, an operator and its value."""

    __test__ = False  # not a test class

    column: str
    operator: str
    value: object = None

    def compiled(self) -> Column:
        return F.coalesce(OPERATORS[self.operator](F.col(self.column), self.value), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Tests of which all (or any) have to hold, with what a hit says."""

    id: str
    kind: str
    severity: str
    tests: tuple[Test, ...]
    any: bool = False

    def compiled(self) -> Column:
        out = None
        for t in self.tests:
            c = t.compiled()
            out = c if out is None else (out | c if self.any else out & c)
        return out if out is not None else F.lit(False)


def hits(rules: Sequence[Rule]) -> Column:
    """Structs (id, kind, severity) of the rules that a row meets, in order."""
    found = [F.when(r.compiled(), F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"))) for r in rules]
    return F.array_compact(F.array(*found))
