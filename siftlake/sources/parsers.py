"""Text parsers of dump formats: pure functions from a text to rows of string cells."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator


def parse_csv(text: str) -> list[list[str]]:
    """A-01: quotes toggle anywhere, doubled quotes inside quotes are one, CR is dropped, an open quote takes the rest."""
    rows, row, cell, quoted = [], [], [], False
    tokens = re.findall(r'"|,|\n|\r|[^",\r\n]+', text)
    doubled = False
    for token, after in zip(tokens, [*tokens[1:], ""][: len(tokens)], strict=True):
        if doubled:  # the second of two quotes within quotes
            doubled = False
        elif token == '"' and quoted and after == '"':
            cell.append('"')
            doubled = True
        elif token == '"':
            quoted = not quoted
        elif token == "\r":
            continue
        elif quoted or token not in (",", "\n"):
            cell.append(token)
        else:
            row.append("".join(cell))
            cell = []
            if token == "\n":
                rows.append(row)
                row = []
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def parse_tsv(text: str) -> list[list[str]]:
    """A-02: lines cut at tabs, nothing quoted or trimmed."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [line.removesuffix("\r").split("\t") for line in lines]


def scalar_text(value) -> str:
    """A-06: a JSON value as a cell."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "[" + ", ".join(scalar_text(v) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=isinstance(value, dict))


def flatten(value: dict, prefix: str = "") -> dict[str, object]:
    """Dotted paths to leaves; arrays are leaves."""
    out: dict[str, object] = {}
    for key, v in value.items():
        path = f"{prefix}{key}"
        out |= flatten(v, f"{path}.") if isinstance(v, dict) else {path: v}
    return out


def json_rows(value) -> list[list[str]]:
    """A-03 to A-05: objects become a header of all sorted paths and their rows; element 0 decides for arrays."""
    if isinstance(value, dict):
        return [_leaves(value)]
    if not isinstance(value, list):
        return [[scalar_text(value)]]
    if not value:
        return []
    if isinstance(value[0], dict):
        flat = [flatten(v) for v in value if isinstance(v, dict)]
        header = sorted({k for f in flat for k in f})
        return [header, *([scalar_text(f.get(k)) for k in header] for f in flat)]
    if isinstance(value[0], list):
        return [[scalar_text(v) for v in row] for row in value if isinstance(row, list)]
    return [[scalar_text(v)] for v in value]


def _leaves(value: dict) -> list[str]:
    return [x for k in sorted(value) for x in (_leaves(value[k]) if isinstance(value[k], dict) else [scalar_text(value[k])])]


def parse_json(text: str) -> list[list[str]]:
    return json_rows(json.loads(text))


def parse_xml(text: str) -> list[list[str]]:
    """A-07: ``[tag with attributes, text]`` of every opening tag that has text right behind it."""
    rows = [[tag, body.strip()] for tag, body in re.findall(r"<([^/!?>][^>]*)>([^<]*)", text) if body.strip()]
    if not rows:
        raise ValueError("no XML content")
    return rows


def parse_csv_line(line: str) -> list[str]:
    """A-08: one physical line; quotes may only enclose whole fields. Raises on anything else."""
    cells, at = [], 0
    while True:
        if at < len(line) and line[at] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=,|$)').match(line, at)
            if not m:
                raise ValueError("unterminated or misplaced quote")
            cells.append(m[1].replace('""', '"'))
            at = m.end()
        else:
            end = line.find(",", at)
            cell = line[at:] if end < 0 else line[at:end]
            if '"' in cell:
                raise ValueError("quote within a field")
            cells.append(cell)
            at += len(cell)
        if at >= len(line):
            return cells
        at += 1


def json_line(value) -> list[str]:
    """A-09: ``key:json`` of an object, JSON items of an array. Raises for scalars."""
    dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if isinstance(value, dict):
        return [f"{k}:{dump(v)}" for k, v in sorted(value.items())]
    if isinstance(value, list):
        return [dump(v) for v in value]
    raise ValueError("neither object nor array")


def parse_jsonl(text: str) -> Iterator[list[str]]:
    for line in text.split("\n"):
        if line.strip():
            yield json_line(json.loads(line))


def parse_json_array(text: str) -> list[list[str]]:
    """A-10, without the loss of what follows an object on its line."""
    value = json.loads(text)
    if not isinstance(value, list):
        raise ValueError("not an array")
    return [json_line(v) for v in value]


#: Whole-file parsers by format; ``register`` adds to them.
PARSERS = {
    "csv": parse_csv, "tsv": parse_tsv, "json": parse_json, "xml": parse_xml, "jsonl": lambda t: list(parse_jsonl(t)),
    "jsonarray": parse_json_array,
}


def parser_of(name: str) -> Callable[[str], list[list[str]]]:
    return PARSERS[name]


def register(name: str, parse: Callable[[str], list[list[str]]]) -> None:
    """K-01: an adapter for files with the extension ``name``: a text to rows of cells; ``ValueError`` marks bad files."""
    if not name.isalnum() or name != name.lower():
        raise ValueError(f"not an extension: {name!r}")
    PARSERS[name] = parse
