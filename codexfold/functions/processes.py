"""Activities, links and calls of process files, in both forms the tool writes.

A process is XML whose groups nest and whose links are joined by name, so one pass
over the tags with a stack reads it: an Arrow UDF, since one malformed document would
make XPath fail the job. The pass is linear; what is not well formed gives what can
be read of it.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column

from codexfold.functions.readers import arrow_reader

# The reader travels with the job, whether or not executors have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS = "array<struct<item:string,name:string,detail:string>>"
_PART = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<(/?)(?:[\w.-]+:)?([\w.-]+)([^<>]*)>|([^<]+)")
_ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*("[^"]*"|'[^']*')""")
# Elements of the executable form that are activities, and their starters.
STARTERS = ("starter", "receive", "onMessage", "eventSource", "receiveEvent")
BASIC = ("invoke", "reply", "assign", "empty", "throw", "rethrow", "wait", "exit", "compensate", "compensateScope", "validate")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _resolved(text: str) -> str:
    if "&" in text:
        for entity, sign in _ENTITIES:
            text = text.replace(entity, sign)
    return text


def _attributes(text: str) -> dict[str, str]:
    return {k.rpartition(":")[2]: _resolved(v[1:-1]) for k, v in reversed(_ATTRIBUTE.findall(text))}


def _called(path: str) -> str:
    """The process that a path or a dotted name leads to."""
    return re.sub(r"\A.*/|\.(?:process|bwp)\Z", "", path.strip())


def items_of(text: str | None) -> list[tuple[str, str, str]]:
    """(item, name, detail): ``activity`` and ``starter`` with their type, ``transition``
    from name to detail, ``call`` of a process."""
    out: list[tuple[str, str, str]] = []
    open_tags: list[str] = []
    owners: list[dict] = []  # activities and transitions that are open
    sources: dict[str, list[str]] = {}
    targets: dict[str, list[str]] = {}

    def finish(owner: dict) -> None:
        found = owner["found"]
        if owner["kind"] == "transition":
            if found.get("from") and found.get("to"):
                out.append(("transition", found["from"], found["to"]))
            return
        name = found.get("name") or found.get("operation") or ""
        kind = "starter" if owner["kind"] in STARTERS or found.get("createInstance") == "yes" else "activity"
        type_ = found.get("type") or found.get("activityTypeID") or ("" if owner["kind"] in ("activity", "starter") else owner["kind"])
        if name:
            out.append((kind, name, type_))
        called = found.get("processName") or found.get("subProcessName")
        if called:
            out.append(("call", _called(called), ""))
        for link in owner["sources"]:
            sources.setdefault(link, []).append(name)
        for link in owner["targets"]:
            targets.setdefault(link, []).append(name)

    for part in _PART.finditer(text or ""):
        closing, tag, rest, said = part.groups()
        if said is not None:
            if owners and open_tags and said.strip() and open_tags[-1] in ("name", "type", "from", "to", "processName", "subProcessName"):
                owners[-1]["found"].setdefault(open_tags[-1], _resolved(said).strip())
            continue
        if tag is None:
            continue
        if closing:
            if tag in open_tags:
                while open_tags.pop() != tag:
                    pass
            while owners and owners[-1]["depth"] > len(open_tags):
                finish(owners.pop())
            continue
        attributes = _attributes(rest)
        alone = rest.rstrip().endswith("/")
        if tag in ("activity", "transition", "activityExtension", "extActivity", *STARTERS, *BASIC):
            owner = {"kind": tag, "depth": len(open_tags) + 1, "found": {k: v for k, v in attributes.items() if v}, "sources": [], "targets": []}
            if alone:
                finish(owner)
            else:
                owners.append(owner)
        elif owners and tag in ("source", "target") and attributes.get("linkName"):
            owners[-1][tag + "s"].append(attributes["linkName"])
        elif owners:
            for k in ("processName", "subProcessName"):
                if attributes.get(k):
                    owners[-1]["found"].setdefault(k, attributes[k])
        if not alone:
            open_tags.append(tag)
    while owners:
        finish(owners.pop())
    out += [("transition", a, b) for link, begins in sources.items() for a in begins for b in targets.get(link, ()) if a and b]
    return out


def process_items(content: Column) -> Column:
    return arrow_reader(content, items_of, ITEMS)
