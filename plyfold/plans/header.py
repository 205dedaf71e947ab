"""Header lines of a document, written and read on the driver: O(columns)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


def quote_name(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", name) else '"' + name.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def quote_value(value: str) -> str:
    """A header value, quoted if it holds a comma, quote, backslash or line end, or white space at an end."""
    if value and value == value.strip() and not re.search(r'[,"\\\n\r\t]', value):
        return value
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = value.replace(raw, written)
    return f'"{value}"'


def split_values(text: str) -> list[str]:
    """Inverse of ", ".join(map(quote_value, values))."""
    out = []
    for m in re.finditer(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,"]*))\s*(?:,|$)', text):
        if m.start() == len(text) and (out or not text) and not text.endswith(","):
            break
        if m[1] is not None:
            out.append(re.sub(r"\\(.)", lambda e: {"n": "\n", "r": "\r", "t": "\t"}.get(e[1], e[1]), m[1], flags=re.S))
        else:
            out.append(m[2].strip())
    return out


def hint(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "?b"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "?d"
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision > 18:
        return "?i"
    return ""


@dataclass
class Header:
    """What the lines before the rows say."""

    level: int = 2
    name: str = "A"
    fields: list[tuple[str, str]] = field(default_factory=list)  # name, hint
    dictionary: list[str] = field(default_factory=list)
    templates: dict[int, tuple[str, str]] = field(default_factory=dict)
    fragments: list[str] = field(default_factory=list)
    rows: int = 0
    checksum: str | None = None
    plan: str | None = None
    schemas: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # all that the lines name; fields are those of the rows

    def lines(self) -> list[str]:
        """Without the checksum line, which covers these."""
        out = [f"@v{self.level}"]
        if self.plan is not None:
            out.append(f"#plan {self.plan}")
        out.append(f"@S {self.name}: " + ", ".join(quote_name(f) + h for f, h in self.fields))
        if self.dictionary:
            out.append("@D: " + ", ".join(map(quote_value, self.dictionary)))
        for i, (a, b) in sorted(self.templates.items()):
            out.append(f"@T {i}: " + "{}".join(x.replace("\\", "\\\\").replace("{}", "\\{\\}").replace("\n", "\\n") for x in (a, b)))
        if self.fragments:
            out.append("@P: " + ", ".join(map(quote_value, self.fragments)))
        return [*out, f"@N{self.rows} {self.name}"]


def kind_of(line: str) -> str:
    """What a header line is, from its first two characters."""
    return {"@v": "version", "@C": "checksum", "@S": "schema", "@D": "dictionary", "@T": "template", "@P": "fragments", "@N": "rows", "@A": "matrix", "#p": "plan"}.get(line[:2], "comment" if line[:1] in ("#", "") else "unknown" if line[:1] == "@" else "data")


def read_header(lines: list[str]) -> tuple[Header, int]:
    """(header, number of lines it takes); unknown @ lines, comments and blank lines are passed over."""
    h = Header()
    for n, line in enumerate(lines):
        kind = kind_of(line)
        if kind == "version":
            m = re.fullmatch(r"@v([123])", line)
            if not m:
                raise ValueError(f"unknown version line {line!r}")
            h.level = int(m[1])
        elif kind == "checksum":
            h.checksum = line[3:]
        elif kind == "plan" and line.startswith("#plan "):
            h.plan = line[6:]
        elif kind == "schema":
            h.name, _, rest = line[3:].partition(": ")
            h.fields = [(re.sub(r"\\(.)", lambda e: "\n" if e[1] == "n" else e[1], m[1]) if m[1] is not None else m[2], m[3] or "") for m in re.finditer(r'(?:"((?:[^"\\]|\\.)*)"|([^,"?]+))(\?[bdins])?(?:, |$)', rest)]
            h.schemas[h.name] = h.fields
        elif kind == "dictionary":
            h.dictionary = split_values(line[4:])
        elif kind == "template":
            i, _, rest = line[3:].partition(": ")
            a, b = (re.sub(r"\\(.)", lambda e: "\n" if e[1] == "n" else e[1], x) for x in re.fullmatch(r"((?:[^\\{]|\\.|\{(?!\}))*)\{\}(.*)", rest, re.S).groups())
            h.templates[int(i)] = (a, b)
        elif kind == "fragments":
            h.fragments = split_values(line[4:])
        elif kind in ("rows", "matrix"):
            m = re.match(r"@[NA]\s?(\d+)\s*(\w*)", line)
            h.rows = int(m[1])
            if kind == "rows" and m[2]:
                h.name, h.fields = m[2], h.schemas.get(m[2], h.fields)
            return h, n + 1
        elif kind == "data":
            return h, n
    return h, len(lines)
