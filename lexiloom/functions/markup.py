"""Outline markup to Textile, document by document: a small state machine over lines, in Arrow batches."""

from __future__ import annotations

import regex
from pyspark.sql.types import StringType

from .text import by_text

HEAD = regex.compile(r"(\*+)\s*(.*)")
ITEM = regex.compile(r"(\s*)(?:(\d+)\.|[+-]+)\s*(.*)")
COMMAND = regex.compile(r"\$\s+.*")
RULE, ROW = regex.compile(r"\s*\|[+-]+\|\s*"), regex.compile(r"\s*(\|.*\|)\s*")
BEGIN, END = (regex.compile(rf"\s*#\+{w}_(CENTER|EXAMPLE|QUOTE|SRC|VERSE)\s*") for w in ("BEGIN", "END"))
OPEN = {"SRC": "<pre><code>", "CENTER": "p=."}
CLOSE = {"SRC": "</code></pre>", "CENTER": ""}


def textile(text: str | None) -> str | None:
    if text is None:
        return None
    out: list[str] = []
    mode, indent, depth = "text", -1, -1

    def leave() -> str:
        nonlocal indent, depth
        gap = "\n" if depth > -1 else ""
        indent = depth = -1
        return gap

    for line in text.split("\n"):
        if mode == "block":
            if m := END.fullmatch(line):
                mode, line = "text", CLOSE.get(m[1], "</pre>")
            out.append(line)
        elif mode == "commands":
            if not COMMAND.fullmatch(line):
                mode, line = "text", "</pre>\n" + line
            out.append(line)
        elif m := HEAD.fullmatch(line):
            out.append(f"{leave()}h{len(m[1])}. {m[2]}\n")
        elif m := ITEM.fullmatch(line):
            # A list deepens when its indent shrinks: the marker's depth follows the order in which indents come.
            width = len(m[1])
            depth = 1 if indent == -1 else depth + (indent > width) - (indent < width)
            indent = width
            out.append(("#" if m[2] else "*") * depth + " " + m[3])
        elif COMMAND.fullmatch(line):
            mode = "commands"
            out.append(leave() + "<pre>\n" + line)
        elif RULE.fullmatch(line):
            if gap := leave():
                out.append(gap)
        elif m := ROW.fullmatch(line):
            out.append(leave() + m[1])
        elif m := BEGIN.fullmatch(line):
            mode = "block"
            out.append(leave() + OPEN.get(m[1], "<pre>"))
        else:
            out.append(leave() + line)
    return "\n".join(out)


to_textile = by_text(textile, StringType())
