"""Project, source and session predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProjectFilter:
    """No match beats values, values beat a substring; an empty filter lets everything through."""

    values: tuple[str, ...] = field(default=())
    substring: str = ""
    no_match: bool = False

    def column(self, project: Column) -> Column:
        if self.no_match:
            return F.lit(False)
        if self.values:
            return F.lower(project).isin(*[v.lower() for v in self.values])
        if self.substring:
            return F.contains(F.lower(project), F.lit(self.substring.lower()))
        return F.lit(True)

    def empty(self) -> bool:
        return not (self.no_match or self.values or self.substring)


EVERYTHING = ProjectFilter()


def source_is(source: str, column: Column) -> Column:
    return column == source if source else F.lit(True)


def id_starts_with(session_id: Column, prefix: str, fold: bool = False) -> Column:
    """The id, or its part after the first colon, begins with the prefix."""
    whole = F.lower(session_id) if fold else session_id
    prefix = prefix.lower() if fold else prefix
    return F.startswith(whole, F.lit(prefix)) | F.startswith(F.split_part(whole, F.lit(":"), F.lit(2)), F.lit(prefix))
