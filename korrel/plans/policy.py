"""Access rules over columns and tables, and masks as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.plans.errors import InvalidDbConfig

STARS, KEEP = "***", 4
_BAD_NAME = re.compile(r"[\"'`\[\].\x00-\x1f]")


@dataclass(frozen=True)
class Mask:
    """``full``: three stars; ``email``: first character and domain; ``partial``: the last ``keep`` characters."""

    mode: str = "full"
    keep: int = KEEP

    def __post_init__(self):
        if self.mode not in ("full", "email", "partial") or self.keep < 0:
            raise InvalidDbConfig(f"mask {self.mode}")

    def column(self, c: Column, kind: T.DataType | None = None) -> Column:
        if isinstance(kind, T.BinaryType):
            return F.when(c.isNotNull(), F.lit(STARS))
        if kind is not None and not isinstance(kind, T.StringType):
            # numbers are masked on their decimal text, anything else whole
            number = isinstance(kind, T.NumericType)
            return (Mask(self.mode, self.keep).column(c.cast("string")) if number else F.when(c.isNotNull(), F.lit(STARS)))
        if self.mode == "full":
            return F.when(c.isNotNull(), F.lit(STARS))
        size = F.char_length(c)
        stars = F.repeat(F.lit("*"), F.greatest(size, F.lit(3)))
        partial = F.when(size <= self.keep, stars).otherwise(F.concat(F.repeat(F.lit("*"), size - self.keep), F.right(c, F.lit(self.keep))))
        if self.mode == "partial":
            return F.when(c.isNotNull(), partial)
        domain = F.substring_index(c, "@", -1)
        at = size - F.char_length(domain)  # characters up to and with the last @; all of them none without
        email = F.concat(F.left(c, F.lit(1)), F.lit(STARS), F.lit("@"), domain)
        return F.when(F.locate("@", c) == 0, partial).when(at <= 1, partial).otherwise(email)


def _rule(text: str) -> tuple[str, str]:
    table, dot, column = text.rpartition(".")
    if not dot or any(not x or len(x) > 128 or _BAD_NAME.search(x) for x in (table, column)):
        raise InvalidDbConfig(f"rule {text!r} isn't table.column")
    return table.lower(), column.lower()


def _matches(pattern: str, name: str) -> bool:
    return pattern in ("*", name.lower())


@dataclass
class Access:
    """Hidden before masked, blocked before allowed. ``strict``: hidden columns may only be plain outputs."""

    hidden: list[str] = field(default_factory=list)
    masked: dict[str, Mask] = field(default_factory=dict)
    blocked: list[str] = field(default_factory=list)
    allowed: list[str] | None = None
    strict: bool = False

    def __post_init__(self):
        self._hidden = [_rule(x) for x in self.hidden]
        self._masked = [(*_rule(x), m) for x, m in self.masked.items()]
        for name in (*self.blocked, *(self.allowed or [])):
            if name != "*" and (len(name) > 128 or _BAD_NAME.search(name)):
                raise InvalidDbConfig(f"table {name!r}")

    def table(self, name: str) -> str:
        if any(_matches(x.lower(), name) for x in self.blocked):
            return "blocked"
        if self.allowed is not None and not any(_matches(x.lower(), name) for x in self.allowed):
            return "not allowed"
        return "open"

    def treatment(self, table: str, column: str) -> str | Mask:
        if any(_matches(t, table) and _matches(c, column) for t, c in self._hidden):
            return "hidden"
        return next((m for t, c, m in self._masked if _matches(t, table) and _matches(c, column)), "plain")

    def guards(self, table: str) -> bool:
        return any(_matches(t, table) for t, *_ in (*self._hidden, *self._masked))

    def merged(self, other: Access) -> Access:
        """Both rule sets together: what either guards is guarded, what either allows only is allowed only."""
        if None in (self.allowed, other.allowed):
            allowed = self.allowed if other.allowed is None else other.allowed
        else:
            allowed = [x for x in self.allowed if x.lower() in {y.lower() for y in other.allowed}]
        return Access([*self.hidden, *other.hidden], other.masked | self.masked, [*self.blocked, *other.blocked], allowed, self.strict or other.strict)


def hide(df: DataFrame, table: str, access: Access, generated: list[str] = ()) -> DataFrame:
    """``df`` with NULL for hidden columns, and for generated columns of a table with guarded ones."""
    also = {x.lower() for x in generated} if access.guards(table) else set()
    return df.select(*(
        F.lit(None).cast(f.dataType).alias(f.name) if access.treatment(table, f.name) == "hidden" or f.name.lower() in also else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ))
