"""The value side of the legacy transforms: the same steps on the rows of a real table.

Every step maps a ``LegacyTable`` (a DataFrame with its current columns and lineage) to
the next one by one ``select``; Catalyst collapses the chain into a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.functions import names, values
from schemaweft.operators.legacy import (
    DROP_ROLE,
    MERGE_ROLES,
    MERGED_NAME,
    SPLIT_NAMES,
    SPLIT_ROLE,
    STANDARD_STEPS,
    UNIT_ROLE,
    check_steps,
)


@dataclass(frozen=True)
class LegacyTable:
    """``df`` with, per current column in order, its original columns (none for junk)."""

    df: DataFrame
    origins: tuple[tuple[str, ...], ...]

    @staticmethod
    def of(df: DataFrame) -> "LegacyTable":
        return LegacyTable(df, tuple((c,) for c in df.columns))

    def lineage(self) -> list[tuple[str | None, str]]:
        """(original, current) pairs in order of the originals, junk last with None."""
        pairs = [(o, c) for c, os in zip(self.df.columns, self.origins) for o in os]
        order = list(dict.fromkeys(o for os in self.origins for o in os))
        pairs.sort(key=lambda p: order.index(p[0]))
        return pairs + [(None, c) for c, os in zip(self.df.columns, self.origins) if not os]

    def current(self, role: str) -> str | None:
        """First current column of an original."""
        return next((c for c, os in zip(self.df.columns, self.origins) if role in os), None)

    def rebuilt(self, parts: list[tuple[Column, str, tuple[str, ...]]]) -> "LegacyTable":
        return LegacyTable(
            self.df.select(*[c.alias(n) for c, n, _ in parts]), tuple(o for _, _, o in parts)
        )

    def parts(self) -> list[tuple[Column, str, tuple[str, ...]]]:
        return [(self.df[f"`{c}`"], c, o) for c, o in zip(self.df.columns, self.origins)]


def _renamed(table: LegacyTable, rule) -> LegacyTable:
    """Apply a rename rule to the header, evaluated by Spark on one row of names."""
    header = table.df.sparkSession.range(1).select(
        *[rule(F.lit(c)).alias(str(i)) for i, c in enumerate(table.df.columns)]
    )
    new_names = list(header.first())
    return table.rebuilt([(c, new, o) for (c, _, o), new in zip(table.parts(), new_names)])


def abbreviate(table: LegacyTable, dictionary: dict[str, str] | None = None) -> LegacyTable:
    return _renamed(table, lambda n: names.abbreviate(n, dictionary))


def strip_vowels(table: LegacyTable) -> LegacyTable:
    return _renamed(table, names.strip_vowels)


def table_prefix(table: LegacyTable, code: str = names.DEFAULT_TABLE_CODE) -> LegacyTable:
    return _renamed(table, lambda n: names.table_prefix(n, code))


def case_flip(table: LegacyTable) -> LegacyTable:
    return _renamed(table, names.case_flip)


def date_format(table: LegacyTable) -> LegacyTable:
    dates = {n for n, t in table.df.dtypes if t in ("timestamp", "timestamp_ntz", "date")}
    return table.rebuilt(
        [(values.date_as_int(c) if n in dates else c, n, o) for c, n, o in table.parts()]
    )


def unit_change(table: LegacyTable, role: str = UNIT_ROLE) -> LegacyTable:
    at = table.current(role)
    return table.rebuilt([(values.minor_units(c) if n == at else c, n, o) for c, n, o in table.parts()])


def split_field(table: LegacyTable, role: str = SPLIT_ROLE) -> LegacyTable:
    at, parts = table.current(role), []
    for c, n, o in table.parts():
        if n == at:
            parts.append((values.first_word(c), SPLIT_NAMES[0], o))
            parts.append((values.last_word(c), SPLIT_NAMES[1], o))
        else:
            parts.append((c, n, o))
    return table.rebuilt(parts)


def merge_fields(table: LegacyTable, roles: tuple[str, str] = MERGE_ROLES) -> LegacyTable:
    at_1, at_2 = table.current(roles[0]), table.current(roles[1])
    if at_1 is None or at_2 is None:
        return table
    by_name = {n: (c, o) for c, n, o in table.parts()}
    (line_1, from_1), (line_2, from_2) = by_name[at_1], by_name[at_2]
    parts = []
    for c, n, o in table.parts():
        if n == at_1:
            parts.append((values.merged_lines(line_1, line_2), MERGED_NAME, from_1 + from_2))
        elif n != at_2:
            parts.append((c, n, o))
    return table.rebuilt(parts)


def drop_column(table: LegacyTable, role: str = DROP_ROLE) -> LegacyTable:
    at = table.current(role)
    return table.rebuilt([p for p in table.parts() if p[1] != at])


def add_junk(table: LegacyTable, key: str | None = None) -> LegacyTable:
    """Junk columns from arithmetic on the current column ``key``, by default the first."""
    at = F.col(f"`{key or table.df.columns[0]}`").cast("bigint")
    return table.rebuilt(table.parts() + [(c, n, ()) for n, c in values.junk_values(at).items()])


TABLE_STEPS = {
    "abbreviate": abbreviate,
    "strip_vowels": strip_vowels,
    "table_prefix": table_prefix,
    "date_format": date_format,
    "split_field": split_field,
    "merge_fields": merge_fields,
    "unit_change": unit_change,
    "case_flip": case_flip,
    "drop_column": drop_column,
    "add_junk": add_junk,
}


def migrate(
    df: DataFrame, steps: Sequence[str] = STANDARD_STEPS, options: dict[str, dict] | None = None
) -> LegacyTable:
    """Apply the named steps to a table; its columns play the roles of their names."""
    check_steps(steps)
    table = LegacyTable.of(df)
    for step in steps:
        table = TABLE_STEPS[step](table, **(options or {}).get(step, {}))
    return table
