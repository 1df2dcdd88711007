"""Keys and values of properties and YAML files, and resolution of properties.

Line continuations, escapes and indentation need state from line to line, so these
are Arrow UDFs over whole texts; what they return is a flat array for Spark to work
on. Lines that are not understood are returned as such, never dropped.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexfold.functions.readers import arrow_reader

# The readers travel with the job, whether or not executors have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "array<struct<document:int,path:array<string>,value:string,line:int,read:boolean>>"
DEEPEST = 500  # levels; a line that nests deeper counts as unread
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "0": "\0", "b": "\b", "e": "\x1b", "/": "/"}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?\Z")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`-][^#]*?|-[^\s#][^#]*?|[^\s#]+?)\s*:(?=\s|\Z)""")
_REFERENCE = re.compile(r"\$\{([^${}]+)\}|\$([A-Za-z_]\w*)")


def _plain(text: str) -> str:
    def sign(found: re.Match) -> str:
        code = found[1]
        return chr(int(code[1:], 16)) if len(code) > 1 else _ESCAPES.get(code, code)

    return _ESCAPE.sub(sign, text) if "\\" in text else text


def properties_of(text: str) -> list[tuple]:
    """Entries of a properties file: logical lines, the key up to ``=``, ``:`` or white space."""
    out, lines, at = [], re.split(r"\r\n|\r|\n", text), 0
    while at < len(lines):
        start, parts = at, [lines[at].lstrip(" \t\f")]
        at += 1
        if not parts[0] or parts[0][0] in "#!":
            continue
        while (len(parts[-1]) - len(parts[-1].rstrip("\\"))) % 2 == 1:
            parts[-1] = parts[-1][:-1]
            if at == len(lines):
                break
            parts.append(lines[at].lstrip(" \t\f"))
            at += 1
        line = "".join(parts)
        k = 0
        while k < len(line) and line[k] not in "=: \t\f":
            k += 2 if line[k] == "\\" else 1
        rest = line[k:].lstrip(" \t\f")
        value = rest[1:].lstrip(" \t\f") if rest[:1] in ("=", ":") else rest
        key = _plain(line[:k])
        out.append((0, [key], _plain(value).rstrip(" \t\f"), start + 1, key != ""))
    return out


def _scalar(text: str) -> str | None:
    """A scalar on one line without its quotes; None for what is none."""
    text = text.strip()
    if text[:1] == '"':
        return _plain(text[1:-1]) if re.fullmatch(r'"(?:[^"\\]|\\.)*"', text) else None
    if text[:1] == "'":
        return text[1:-1].replace("''", "'") if re.fullmatch(r"'(?:[^']|'')*'", text) else None
    if text[:1] in ("*", "!", "@", "`", "%", "{", "["):
        return None
    return "" if text in ("~", "null", "Null", "NULL") else text


def _uncommented(line: str) -> str:
    """A line without its comment, which starts at ``#`` after white space, outside quotes."""
    if "#" not in line:
        return line.rstrip()
    quote = None
    for k, sign in enumerate(line):
        if quote:
            if sign == quote and not (quote == '"' and line[k - 1] == "\\"):
                quote = None
        elif sign in "\"'" and (k == 0 or line[k - 1] in " \t[{,:-"):
            quote = sign
        elif sign == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


_FLOW = re.compile(r"""\s*([\[\]{},]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\[\]{},:"']|:(?!\s))+|:)""")


def _flow(path: list[str], text: str) -> list[tuple[list[str], str]] | None:
    """Entries of a list or map in signs, on one line; None for what is none."""
    out: list[tuple[list[str], str]] = []
    stack: list[list] = []  # [opening sign, path, count, key or None, value seen]
    at, here = 0, path
    while True:
        found = _FLOW.match(text, at)
        if not found:
            return None
        at, token = found.end(), found[1].strip()
        if token in ("[", "{"):
            if len(stack) == DEEPEST:
                return None
            stack.append([token, here, 0, None, False])
        elif not stack:
            return None
        elif token in ("]", "}", ","):
            top = stack[-1]
            if top[0] == "{" and top[3] is not None and not top[4]:
                out.append(([*top[1], top[3]], ""))
            if token == ",":
                top[2], top[3], top[4] = top[2] + 1, None, False
            elif (token == "]") != (top[0] == "["):
                return None
            else:
                stack.pop()
                if top[2] == 0 and top[3] is None and not top[4]:
                    out.append((top[1], ""))
                if not stack:
                    return out if not text[at:].strip() else None
                stack[-1][4] = True
                continue
        elif token == ":":
            continue
        elif stack[-1][0] == "{" and stack[-1][3] is None:
            key = _scalar(token)
            if key is None:
                return None
            stack[-1][3] = key
        else:
            value = _scalar(token)
            if value is None:
                return None
            top = stack[-1]
            out.append(([*top[1], f"[{top[2]}]" if top[0] == "[" else top[3]], value))
            top[4] = True
        top = stack[-1]
        here = [*top[1], f"[{top[2]}]"] if top[0] == "[" else [*top[1], top[3] or ""]


def yaml_of(text: str) -> list[tuple]:
    """Entries of a YAML file: block maps and lists by a stack of indents, scalars plain,
    quoted, literal and folded, lists and maps in signs on one line, several documents.
    References, tags and quoted scalars over several lines are returned as unread."""
    out: list[list] = []
    frames: list[list] = []  # [indent, kind, path, items or children]
    document, at, lines = 0, 0, re.split(r"\r\n|\r|\n", text)
    last: list | None = None  # the entry a deeper plain line continues, with its indent

    def close(until: int, keep_list: bool) -> None:
        """Leaves what is indented as far as ``until``; a list of that indent may go on."""
        while frames and (frames[-1][0] > until or (frames[-1][0] == until and not (keep_list and frames[-1][1] in ("list", "key")))):
            indent, kind, path, n, line = frames.pop()
            if kind == "key" and not n:
                out.append([document, path, "", line, True])

    def path_above() -> list[str]:
        if frames:
            frames[-1][3] += 1
            return frames[-1][2]
        return []

    while at < len(lines):
        number, raw = at + 1, lines[at]
        at += 1
        line = _uncommented(raw)
        body = line.lstrip(" ")
        if not body:
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|\Z)", line):
            close(-1, False)
            document += line.startswith("---") and bool(out)
            last = None
            continue
        if line.startswith("%") and not frames:
            continue
        indent = len(line) - len(body)
        if last is not None and indent > last[0] and not body.startswith("- ") and not _KEY.match(body):
            last[1][2] = f"{last[1][2]} {body}".strip()
            continue
        last, unread = None, body.startswith("\t")
        while not unread and (body == "-" or body.startswith("- ")):
            close(indent, True)
            if frames and frames[-1][1] == "item" and frames[-1][0] == indent:
                frames.pop()
            if not (frames and frames[-1][1] == "list" and frames[-1][0] == indent):
                frames.append([indent, "list", path_above(), 0, number])
            path = [*frames[-1][2], f"[{frames[-1][3]}]"]
            frames[-1][3] += 1
            frames.append([indent, "item", path, 0, number])
            after = body[1:].lstrip(" ")
            indent, body = indent + len(body) - len(after), after
            unread = len(frames) > DEEPEST
            if not body:
                break
        if not body and not unread:
            continue
        found = None if unread else _KEY.match(body)
        if found:
            key, value = _scalar(found[1]), body[found.end() :].strip()
            close(indent, False)
            if key is None or key == "<<":
                unread = True
            else:
                path = [*path_above(), key]
        elif not unread:
            value, path = body, list(frames[-1][2]) if frames and frames[-1][1] == "item" and frames[-1][0] < indent and frames[-1][3] == 0 else None
            if path is None and not (body[0] in "{[" and not frames and not out):
                unread = True
            path = path or []
        if not unread:
            value = re.sub(r"\A&\S+\s*", "", value)
            if _BLOCK.match(value):
                parts = []
                while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > (indent if found else frames[-1][0])):
                    parts.append(lines[at])
                    at += 1
                while parts and not parts[-1].strip():
                    parts.pop()
                lead = min((len(p) - len(p.lstrip(" ")) for p in parts if p.strip()), default=0)
                out.append([document, path, ("\n" if value[0] == "|" else " ").join(p[lead:] for p in parts), number, True])
            elif found and not value:
                frames.append([indent, "key", path, 0, number])
            elif value[:1] in ("{", "["):
                entries = _flow(path, value)
                unread = entries is None
                out += [[document, p, v, number, True] for p, v in entries or ()]
            else:
                said = _scalar(value)
                unread = said is None
                if not unread:
                    out.append([document, path, said, number, True])
                    if value[0] not in "\"'":
                        last = [indent if found else frames[-1][0], out[-1]]
        if unread:
            out.append([document, [], raw, number, False])
    close(-1, False)
    return [tuple(x) for x in out]


def key_of(path: Column) -> Column:
    """``a.b[0].c`` of a path."""
    return F.regexp_replace(F.array_join(path, "."), r"\.(?=\[\d+\](?:\.|\[|\z))", "")


def _entries(content: Column, reader) -> Column:
    return arrow_reader(content, lambda text: None if text is None else reader(text), ENTRIES)


def properties_entries(content: Column) -> Column:
    return _entries(content, properties_of)


def yaml_entries(content: Column) -> Column:
    return _entries(content, yaml_of)


def substituted(text: str, values: dict[str, str]) -> str:
    """``text`` with ``${name}`` and ``$name`` replaced by their values, these too, as long
    as a value does not lead back to its own name; unknown names stay."""

    def one(found: re.Match, used: frozenset) -> str:
        name = found[1] or found[2]
        if name not in values or name in used:
            return found[0]
        return _REFERENCE.sub(lambda m: one(m, used | {name}), values[name])

    return _REFERENCE.sub(lambda m: one(m, frozenset()), text)


def resolved(text: Column, definitions: Column) -> Column:
    """``substituted`` with an array of (name, value); the first of a name counts."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for t, pairs in zip(texts, known):
            if t is not None and pairs is not None and "$" in t:
                t = substituted(t, {p["name"]: p["value"] for p in reversed(list(pairs))})
            out.append(t)
        return pd.Series(out, dtype=object)

    return replace(text, definitions)
