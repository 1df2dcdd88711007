"""Declarations of Java sources, by one pass over their tokens.

Nesting (type arguments, argument lists, bodies) is beyond regular expressions, so
this is an Arrow UDF: a text goes in, its types with annotations and members come
out, and everything further is Spark's. The pass is linear and has no limits on
lengths or depth; a text that is not Java gives what can be read of it.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column

from codexfold.functions.readers import arrow_reader

# The reader travels with the job, whether or not executors have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANNOTATIONS = "array<struct<name:string,arguments:array<struct<key:string,values:array<string>>>>>"
PARENTS = "array<struct<relation:string,parent:string>>"
DECLARATIONS = f"array<struct<kind:string,type:string,parents:{PARENTS}>>"
ROUTES = "array<struct<verb:string,route:string>>"
TYPES = (
    f"array<struct<kind:string,type:string,parents:{PARENTS},annotations:{ANNOTATIONS},"
    f"members:array<struct<target:string,annotations:{ANNOTATIONS}>>>>"
)

# Comments and white space fall away; a string is one token. Common tokens come first.
_TOKEN = re.compile(
    r"""\s*+([^\W\d]\w*+|[@(){};,<>=\[\]]|\.(?![\d.]*\d)|\"{3}(?s:.*?)(?:\"{3}|\Z)|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)|[\d.]*\d\w*|\S|\Z)"""
)
# What stands before the first declaration: nothing is open there, so whole statements
# and comments fall away. Possessive, so linear.
_LEAD = re.compile(r"(?:\s++|//[^\n]*+|/\*(?s:.*?)\*/|(?:package|import(?:\s++static)?+)\s++[^\W\d][\w.]*+(?:\*)?+\s*+;)*+")
_ESCAPE = re.compile(r"\\(.)")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "s": " "}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "sealed", "strictfp", "default"}
_BEFORE_TYPE = _MODIFIERS | {None, ";", "{", "}", ")", "@"}
_KINDS = {"class", "interface", "enum", "record"}
_KIND = re.compile("class|interface|enum|record")
_VERB = re.compile(r"(?<!\w)(\w++)\W*+\Z", re.ASCII)  # the last word of RequestMethod.GET
_SLASHES = re.compile("/{2,}")
_TURNS = _KINDS | {"@", "(", ";", "{", "}", "="}  # all other tokens only name things
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


def tokens_of(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text, _LEAD.match(text).end()) if t and (t[0] != "/" or t[:2] not in ("//", "/*"))]


def _string(token: str) -> str | None:
    """What a string token says, None for other tokens."""
    if token[0] != '"' or len(token) < 2:
        return None
    body = token[3:].removesuffix('"""') if token.startswith('"""') else token[1:-1]
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m[1], m[1]), body)


class _Reader:
    def __init__(self, text: str):
        self.tokens = tokens_of(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def annotation(self) -> dict:
        """From ``@`` to behind the argument list."""
        near = self.tokens[self.at + 1 : self.at + 7]
        if len(near) == 6 and near[0][0].isidentifier() and near[1] != ".":  # a plain name, and none or one string
            if near[1] != "(":
                self.at += 2
                return {"name": near[0], "arguments": []}
            key, k = (near[2], 4) if near[3] == "=" else ("", 2)
            if near[2] != ")" and near[k + 1] == ")" and near[k][0] == '"' and (said := _string(near[k])) is not None:
                self.at += k + 3
                return {"name": near[0], "arguments": [{"key": key, "values": [said]}]}
        self.at += 1
        name = self.dotted()
        arguments = []
        if self.peek() == "(":
            self.at += 1
            while self.peek() not in (None, ")"):
                key = ""
                if self.peek(1) == "=" and self.peek(2) != "=":
                    key = self.peek()
                    self.at += 2
                arguments.append({"key": key, "values": self.values()})
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() not in (None, ")"):
                    self.at += 1  # not Java; go on
            self.at += 1
        return {"name": name.rpartition(".")[2], "arguments": arguments}

    def skip_annotation(self) -> None:
        self.at += 1
        self.dotted()
        if self.peek() == "(":
            self.skip("(", ")")

    def dotted(self) -> str:
        tokens, at, n = self.tokens, self.at, len(self.tokens)
        while at < n and (tokens[at] == "." or tokens[at][0].isidentifier()):
            if at > self.at and tokens[at] != "." and tokens[at - 1] != ".":
                break
            at += 1
        name = "".join(tokens[self.at : at])
        self.at = at
        return name

    def values(self) -> list[str]:
        """One value or a list of them; what is no string stands as ``${name}``."""
        if self.peek() != "{":
            return [self.value()]
        self.at += 1
        out = []
        while self.peek() not in (None, "}"):
            out.append(self.value())
            if self.peek() == ",":
                self.at += 1
            elif self.peek() in _CLOSE - {"}"}:
                self.at += 1
        self.at += 1
        return out

    def value(self) -> str:
        out, name, depth = [], [], 0

        def end_name() -> None:
            if name:
                out.append("${" + "".join(name) + "}")
                name.clear()

        while (token := self.peek()) is not None:
            if token == "@":
                self.skip_annotation()
                continue
            if depth == 0 and (token == "," or token in _CLOSE):
                break
            depth += (token in _OPEN) - (token in _CLOSE)
            if (said := _string(token)) is not None:
                end_name()
                out.append(said)
            elif token == "+" and depth == 0:
                end_name()
            else:
                name.append(token)
            self.at += 1
        end_name()
        return "".join(out)

    def skip(self, opening: str, closing: str) -> None:
        """From an opening sign to behind its closing one."""
        depth, at, tokens = 0, self.at, self.tokens
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == opening:
                depth += 1
            elif token == closing:
                depth -= 1
                if depth == 0:
                    break
        self.at = at

    def is_type(self, before: str | None) -> bool:
        name = self.peek(1)
        if self.peek() not in _KINDS or before not in _BEFORE_TYPE or name is None or not name.isidentifier():
            return False
        return self.peek(2) in (("(", "<") if self.peek() == "record" else ("<", "{", "extends", "implements", "permits"))

    def header(self, annotations: list[dict]) -> dict:
        """A type from its keyword up to its body."""
        tokens, n = self.tokens, len(self.tokens)
        kind, name = tokens[self.at : self.at + 2]
        self.at += 2
        parents, relation = [], None
        while self.at < n and (token := tokens[self.at]) not in ("{", ";", "}"):
            if token == "<":
                self.skip("<", ">")
            elif token == "(":
                self.skip("(", ")")
            elif token == "@":
                self.skip_annotation()
            elif token in ("extends", "implements", "permits"):
                relation = token
                self.at += 1
            elif token[0].isidentifier():
                parent = self.dotted()
                if relation in ("extends", "implements"):
                    parents.append({"relation": relation, "parent": parent})
            else:
                self.at += 1
        return {"kind": kind, "type": name, "parents": parents, "annotations": annotations, "members": []}


def _target(signature: list[str]) -> str:
    """The simple name of a member's type, or of its last type argument."""
    words, depth = [], 0
    for token in signature[:-1]:
        depth += (token == "<") - (token == ">")
        if token == "," and depth == 1 or token == "<" and depth == 1:
            words = []
        elif token[0].isidentifier() and depth <= 1 and not (words and token in ("extends", "super")):
            words.append(token)
        elif token == "?" and depth == 1:
            words = []
    names = [w for w in words if w not in ("extends", "super")]
    return names[-1] if names else ""


def types_of(text: str | None, targets: bool = True) -> list[dict]:
    """All types of a text, outer ones first, each with its annotated members; without
    ``targets`` these have none."""
    if not _KIND.search(text or ""):
        return []
    reader, out = _Reader(text), []
    tokens, n = reader.tokens, len(reader.tokens)
    open_types: list[tuple[int, dict]] = []  # depth of the body, type
    at, depth, before = 0, 0, None
    annotations, signature, named = [], [], False
    while at < n:
        token = tokens[at]
        if token not in _TURNS:
            start = at
            at += 1
            while at < n and tokens[at] not in _TURNS:
                at += 1
            if targets and annotations and not named:
                signature += [t for t in tokens[start:at] if t not in _MODIFIERS]
            before = tokens[at - 1]
            continue
        reader.at = at
        if token == "@":
            if reader.peek(1) == "interface":
                reader.at += 2
            else:
                annotations.append(reader.annotation())
            at, before = reader.at, "@"
            continue
        if token in _KINDS and reader.is_type(before):
            made = reader.header(annotations)
            out.append(made)
            annotations, signature, named, before = [], [], False, None
            at = reader.at
            if reader.peek() == "{":
                depth += 1
                open_types.append((depth, made))
                at += 1
            continue
        if token == "(":
            named = True
            reader.skip("(", ")")
            at, before = reader.at, ")"
            continue
        if token in _KINDS:
            if annotations and not named:
                signature.append(token)
        elif token == "=":
            named = True
        else:  # the end of a member
            if annotations and open_types and open_types[-1][0] == depth:
                open_types[-1][1]["members"].append({"target": _target(signature) if targets else "", "annotations": annotations})
            annotations, signature, named = [], [], False
            depth += (token == "{") - (token == "}")
            if token == "}" and open_types and open_types[-1][0] > depth:
                open_types.pop()
        before = token
        at += 1
    return out


def _last_kind(text: str) -> int:
    """Where the last word stands that may begin a declaration, -1 without one."""
    last = -1
    for kind in _KINDS:
        at = text.rfind(kind)
        while at > last:
            end = at + len(kind)
            prior, later = text[at - 1 : at], text[end : end + 1]
            if not (prior.isalnum() or later.isalnum() or prior in (".", "_") or later == "_"):
                last = at
            at = text.rfind(kind, 0, at)
    return last


def _declarations(text: str, whole: bool) -> list[dict] | None:
    """The types of a text, or of the beginning of one: then None if a header does not end in it."""
    reader, out = _Reader(text), []
    tokens, n = reader.tokens, len(reader.tokens)
    at, before = 0, None
    while at < n:
        token = tokens[at]
        if token == "@":
            reader.at = at
            if reader.peek(1) == "interface":
                at += 2
            else:
                reader.annotation()
                at = reader.at
        elif token == "(":
            reader.at = at
            reader.skip("(", ")")
            at, token = reader.at, ")"
        elif token in _KINDS:
            if at + 2 >= n and not whole:
                return None
            reader.at = at
            if reader.is_type(before):
                out.append(reader.header([]))
                at, token = reader.at, None
                if at >= n and not whole:
                    return None
                if reader.peek() == "{":
                    at += 1
            else:
                at += 1
        else:
            at += 1
        before = token
    return out


def declarations_of(text: str | None) -> list[dict]:
    """What ``types_of`` gives, without annotations and members.

    Nothing behind the header of the last word that may begin a type declares one, so the
    text is read up to there. It is cut at a line end: no string or line comment runs over
    it, and of a block comment or text block that does only the beginning is read.
    """
    last = _last_kind(text or "")
    if last < 0:
        return []
    brace = text.find("{", last)
    cut = text.find("\n", brace) if brace >= 0 else -1
    found = _declarations(text[:cut], False) if cut >= 0 else None
    return _declarations(text, True) if found is None else found


def _arguments(annotation: dict, *keys: str) -> list[str]:
    """Values of the arguments with one of ``keys``; '' is the key of one without a name."""
    return [v for x in annotation["arguments"] if x["key"] in keys for v in x["values"]]


def routes_of(text: str | None, spring_verbs: dict[str, str], jaxrs_verbs: tuple[str, ...]) -> list[tuple[str, str]]:
    """The different (verb, route) of a text, by the rules of ``corpus.endpoints``."""
    found = {}
    for made in types_of(text, targets=False):
        prefixes = None
        for member in made["members"]:
            annotations, own = member["annotations"], None
            for a in annotations:
                name = a["name"]
                if name in jaxrs_verbs:
                    if own is None:
                        own = [v for x in annotations if x["name"] == "Path" for v in _arguments(x, "", "value", "path")] or [""]
                    verbs, at = (name,), own
                elif name == "RequestMapping":
                    words = [_VERB.search(v) for v in _arguments(a, "method")]
                    verbs, at = [w[1] if w else "" for w in words] or ("ANY",), _arguments(a, "", "value", "path") or ("",)
                elif name in spring_verbs:
                    verbs, at = (spring_verbs[name],), _arguments(a, "", "value", "path") or ("",)
                else:
                    continue
                if prefixes is None:
                    prefixes = [v for x in made["annotations"] if x["name"] in ("RequestMapping", "Path") for v in _arguments(x, "", "value", "path")] or [""]
                for path in at:
                    for prefix in prefixes:
                        route = _SLASHES.sub("/", f"/{prefix}/{path}")
                        if len(route) > 1 and route[-1] == "/":
                            route = route[:-1]
                        for verb in verbs:
                            found[verb, route] = None
    return list(found)


def java_types(content: Column) -> Column:
    """Array of the types declared in a Java source."""
    return arrow_reader(content, types_of, TYPES)


def java_declarations(content: Column) -> Column:
    """The same types, without annotations and members."""
    return arrow_reader(content, declarations_of, DECLARATIONS)


def java_routes(content: Column, spring_verbs: dict[str, str], jaxrs_verbs: tuple[str, ...]) -> Column:
    """Array of the different verbs and routes of a Java source."""
    return arrow_reader(content, lambda text: [{"verb": v, "route": r} for v, r in routes_of(text, spring_verbs, jaxrs_verbs)], ROUTES)
