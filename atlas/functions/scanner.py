"""One linear pass over wiki markup: which brackets match.

Nested brackets are beyond regular expressions; this is the only step that runs
in Python workers.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import from_arrow_type

# Ship the scanner inside the task, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARAM = pa.struct([("name", pa.string()), ("value", pa.string()), ("positional", pa.bool_())])
_TEMPLATE = pa.struct([("name", pa.string()), ("params", pa.list_(_PARAM))])
_SCAN = pa.struct([
    ("templates", pa.list_(_TEMPLATE)), ("links", pa.list_(pa.string())), ("plain", pa.string()),
])

_RAW = ("nowiki", "pre", "math", "source", "syntaxhighlight", "gallery", "timeline")
_TOKEN = re.compile(
    rf"<!--|<(?P<raw>{'|'.join(_RAW)})\b[^<>]*>|\{{\{{+|\}}\}}+|\[\[|\]\]|\||=", re.IGNORECASE)
_CLOSER = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}
_CLOSER["<!--"] = re.compile("-->")
_INVISIBLE = {"math", "gallery", "timeline", "<!--"}
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)

# Characters of text whose results a worker holds as Python objects, and what a row adds to them.
SLICE, _ROW = 1 << 20, 100


class _Open:
    """A bracket that is still open: where it starts and its top-level bars and equals signs.

    ``broken`` marks a link with another link in its target, which is no link.
    """

    __slots__ = ("kind", "start", "body", "bars", "equals", "broken")

    def __init__(self, kind, start, body):
        self.kind, self.start, self.body = kind, start, body
        self.bars, self.equals, self.broken = [], [], False


def _template(text, frame, end, wanted):
    name = _COMMENT.sub("", text[frame.body:frame.bars[0] if frame.bars else end]).strip()
    params, position = [], 0
    if not name.lower().startswith(wanted):
        return {"name": name, "params": params}
    cuts = [frame.body - 1, *frame.bars, end]
    pieces = [(a + 1, b) for a, b in zip(cuts, cuts[1:])]
    equals = iter(frame.equals)
    mark = next(equals, None)
    for start, stop in pieces[1:]:
        while mark is not None and mark < start:
            mark = next(equals, None)
        if mark is not None and mark < stop:
            params.append({"name": _COMMENT.sub("", text[start:mark]).strip(),
                           "value": text[mark + 1:stop], "positional": False})
        else:
            position += 1
            params.append({"name": str(position), "value": text[start:stop], "positional": True})
    return {"name": name, "params": params}


def scan_text(text: str, wanted: tuple[str, ...] = ("",), with_plain: bool = True) -> dict:
    """Templates and links by opening position, and the text outside markup.

    A closing bracket ends the nearest open one of its kind; openers left inside
    it, or never closed at all, are ordinary text.  Parameters are given for
    templates whose lower-case name starts with one of ``wanted``.
    """
    stack, counts = [], {"{": 0, "[": 0}
    templates, links, hidden = [], [], []

    def close(kind):
        while stack[-1].kind != kind:
            # never closed, hence text: its bars and equals signs belong to what it stands in
            left = stack.pop()
            counts[left.kind] -= 1
            stack[-1].bars += left.bars
            stack[-1].equals += left.equals
        counts[kind] -= 1
        return stack.pop()

    unclosed, position = set(), 0
    while match := _TOKEN.search(text, position):
        token, at, position = match.group(), match.start(), match.end()
        head = token[0]
        if head == "<":
            kind = (match["raw"] or "<!--").lower()
            if not token.endswith("/>"):
                # where one search finds no closer, no later one will
                end = None if kind in unclosed else _CLOSER[kind].search(text, position)
                if end is None:
                    unclosed.add(kind)
                    continue
                position = end.end()
            if kind in _INVISIBLE:
                hidden.append((at, position))
        elif head == "{":
            run = len(token)
            while run >= 2:
                width = 3 if run == 3 else 2
                run -= width
                body = at + len(token) - run
                stack.append(_Open("{", body - width, body))
                counts["{"] += 1
        elif head == "}":
            run, here = len(token), at
            while run >= 2 and counts["{"]:
                frame = close("{")
                width = frame.body - frame.start
                if width == 3 and run < 3:
                    width, frame.start = 2, frame.start + 1
                if width == 2:
                    templates.append((frame.start, _template(text, frame, here, wanted)))
                hidden.append((frame.start, here + width))
                run, here = run - width, here + width
        elif token == "[[":
            if stack and stack[-1].kind == "[" and not stack[-1].bars:
                stack[-1].broken = True
            stack.append(_Open("[", at, match.end()))
            counts["["] += 1
        elif token == "]]":
            if counts["["]:
                frame = close("[")
                if frame.broken:
                    continue
                title_end = frame.bars[0] if frame.bars else at
                title = text[frame.body:title_end]
                if title and "\n" not in title:
                    links.append((frame.start, title))
                    shown = title_end + 1 if frame.bars else frame.body
                    hidden += [(frame.start, shown), (at, at + 2)]
        elif stack:
            (stack[-1].bars if head == "|" else stack[-1].equals).append(at)

    by_start = lambda item: item[0]
    return {
        "templates": [t for _, t in sorted(templates, key=by_start)],
        "links": [link for _, link in sorted(links, key=by_start)],
        "plain": _outside(text, hidden) if with_plain else None,
    }


def _outside(text, hidden):
    """The text outside the hidden stretches."""
    shown, position = [], 0
    for start, stop in sorted(hidden):
        if start > position:
            shown.append(text[position:start])
        position = max(position, stop)
    shown.append(text[position:])
    return "".join(shown)


def scanned_slices(texts: Iterator[str | None], wanted: tuple[str, ...] = ("",), with_plain: bool = True) -> Iterator[pa.Array]:
    """What ``scan_text`` gives for each text, in order, as arrays over about ``SLICE`` characters of text each.

    As Python objects the results take several times the room of their texts, so that a worker's
    memory would grow with the rows that it is handed at a time.
    """
    found, size = [], 0
    for text in texts:
        found.append(scan_text(text or "", wanted, with_plain))
        size += len(text or "") + _ROW
        if size >= SLICE:
            yield pa.array(found, type=_SCAN)
            found, size = [], 0
    if found:
        yield pa.array(found, type=_SCAN)


def scan(text: Column, wanted: tuple[str, ...] = ("",), with_plain: bool = True) -> Column:
    """``struct<templates, links, plain>`` of a markup column; see ``scan_text``.

    Marked non-deterministic only to keep the optimizer from scanning a text once
    more for every filter on something derived from it.
    """
    @F.arrow_udf(from_arrow_type(_SCAN))
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from scanned_slices((t.as_py() for t in batch), wanted, with_plain)

    return scanned.asNondeterministic()(text)
