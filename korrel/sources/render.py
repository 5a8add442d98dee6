"""Result rows as JSON, CSV or Markdown, within caps on cells and bytes."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from dataclasses import dataclass, field

from korrel.plans.errors import UnknownFormat

BLOB_HEX = 64


@dataclass
class Rendered:
    text: str
    rows: int
    cut_cells: int
    stopped: str  # "none" or "bytes"
    columns: list[str] = field(default_factory=list)


def _plain(value):
    """A value in the few kinds that are written: None, int, float, str, bytes, or nested for JSON."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None or isinstance(value, (int, float, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, decimal.Decimal):
        return float(value) if len(value.as_tuple().digits) <= 15 else str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    return json.dumps(value, default=str, ensure_ascii=False, separators=(",", ":"))


def _blob(value: bytes) -> str:
    return f"x'{value.hex()}'" if len(value) <= BLOB_HEX else f"<blob {len(value)} bytes>"


def _number(value) -> str:
    if isinstance(value, float) and value == int(value) if isinstance(value, float) and math.isfinite(value) else False:
        return str(int(value)) if abs(value) < 1e15 else repr(value)
    return str(value)


class Renderer:
    def __init__(self, form: str, max_cell_chars: int, max_bytes: int):
        if form not in ("json", "csv", "markdown"):
            raise UnknownFormat(form)
        self.form, self.most, self.max_bytes, self.cut = form, max_cell_chars, max_bytes, 0

    def _clip(self, text: str) -> str:
        if len(text) <= self.most:
            return text
        self.cut += 1
        return f"{text[: self.most]}…[+{len(text) - self.most} chars]"

    def cell(self, value, nested: bool) -> str:
        plain = _plain(value)
        if isinstance(plain, bytes):
            plain = _blob(plain)
            text = plain
        elif isinstance(plain, str):
            if self.form == "json" and nested and len(plain) <= self.most:
                return plain
            text = self._clip(plain)
        elif isinstance(plain, float) and not math.isfinite(plain):
            text = "NaN" if math.isnan(plain) else "Infinity" if plain > 0 else "-Infinity"
        elif plain is None:
            return {"json": "null", "csv": "", "markdown": "NULL"}[self.form]
        else:
            return _number(plain)
        if self.form == "json":
            return json.dumps(text, ensure_ascii=False)
        if self.form == "csv":
            return self.quoted(text)
        return text.replace("|", "\\|").replace("\n", "<br>").replace("\r", "")

    @staticmethod
    def quoted(text: str) -> str:
        return '"' + text.replace('"', '""') + '"' if any(x in text for x in ',"\r\n') else text

    def render(self, columns: list[str], rows) -> Rendered:
        """``rows`` is read until one doesn't fit into the bytes."""
        if self.form == "csv":
            out = [",".join(map(self.quoted, columns)) + "\n"]
        elif self.form == "markdown":
            out = ["|" + "".join(f" {c} |" for c in columns) + "\n", "|" + " --- |" * len(columns) + "\n"]
        else:
            out = []
        used, count, stopped = sum(len(x.encode()) for x in out), 0, "none"
        for row in rows:
            before = self.cut
            cells = [self.cell(x, isinstance(x, (list, dict, tuple))) for x in row]
            line = {"json": lambda: "[" + ",".join(cells) + "]", "csv": lambda: ",".join(cells) + "\n", "markdown": lambda: "|" + "".join(f" {c} |" for c in cells) + "\n"}[self.form]()
            size = len(line.encode()) + (self.form == "json")
            if used + size > self.max_bytes:
                stopped, self.cut = "bytes", before
                break
            out.append(line)
            used += size
            count += 1
        text = "[" + ",".join(out) + "]" if self.form == "json" else "".join(out)
        return Rendered(text, count, self.cut, stopped, columns)
