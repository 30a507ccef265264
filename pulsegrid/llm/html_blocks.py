"""Pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements whose content is never text of the page, up to their own end tag; those of NESTED may hold others of their name.
RAW = frozenset("script style noscript template title svg iframe object canvas select textarea button".split())
NESTED = frozenset("template svg object".split())
#: Unclosed, these take the rest of the page; the others are then ignored.
ENDLESS = frozenset(("script", "style"))
#: Levels of a tag path that a block keeps: the outermost and the innermost.
OUTER, INNER = 16, 48
#: Names of a level that a block keeps; elements with more are told by their first ones.
MARKS = 12
#: Within a drawing these end it, as they do in browsers, but not within foreign objects of it.
_LEAVES = "p|div|h[1-6]|ul|ol|dl|li|table|article|section|main|nav|header|footer|aside|blockquote|pre|body|hr"
#: Elements that part blocks; all others, unknown ones too, stand within a text.
PARTS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open one of the listed kinds, as far as the boundary elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDARY = frozenset("ul ol dl table body html article section div main".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: list[str]
    text: str
    linked: int  # characters inside links


def _marks(attributes: str) -> list[str]:
    out = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and "none" in value.replace(" ", "").lower():
            out.append("@hidden")
        elif name != "style":
            out += ["." + w for w in _NAME.findall(value.lower())]
    return out[:MARKS]


def _raw_end(page: str, name: str, at: int, limit: int) -> int:
    """Where the raw element that is open at ``at`` ends; -1 if nothing closes it.

    A drawing that another element breaks into ends there.  ``limit`` is the
    last ``>``; ends of tags are looked for ahead of the last one found, so the
    time is that of one pass.
    """
    drawing = name == "svg"
    depth, last, foreign, behind = 1, -1, 0, at
    for tag in re.compile(rf"<(/?)({name}{'|foreignobject|' + _LEAVES if drawing else ''})(?=[\s/>])", re.I).finditer(page, at, limit + 1):
        said, closing = tag[2].lower(), bool(tag[1])
        if said == "foreignobject":
            foreign = max(0, foreign + (-1 if closing else 1))
            continue
        if said != name:
            if not closing and not foreign:
                return tag.start()
            continue
        if behind < tag.end():
            behind = page.find(">", tag.end(), limit + 1)
        if closing:
            depth, last = depth - 1, behind + 1
            if not depth or name not in NESTED:
                break
        elif page[behind - 1] != "/":
            depth += 1
    return last


def tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """``(None, False, text)`` and ``(tag, closing, attributes)`` in page order, without comments and raw elements.

    Every step goes ahead, so a page is read in time in proportion to its
    length: what was searched for in vain once is not searched for again.  A
    tag whose quotes never close ends, like all after it, at the next ``>``.
    """
    at, last, quoted, unclosed = 0, page.rfind(">"), True, set()
    while at < len(page):
        less = page.find("<", at)
        comment = less >= 0 and page.startswith("<!--", less)
        if less < 0 or less > last and not comment:
            yield None, False, page[at:]
            return
        if less > at:
            yield None, False, page[at:less]
        if comment:
            end = page.find("-->", less + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page[less + 1] in "!?":
            at = page.find(">", less) + 1
            continue
        tag = _TAG.match(page, less)
        if not tag:
            yield None, False, "<"
            at = less + 1
            continue
        found = _ATTRIBUTES.match(page, tag.end()) if quoted else None
        quoted = quoted and found is not None
        at = found.end() if found else page.find(">", tag.end()) + 1
        name, closing, attributes = tag[2].lower(), bool(tag[1]), page[tag.end() : at - 1]
        if name in RAW and not closing:
            if name in unclosed or name == "svg" and attributes.endswith("/"):
                continue
            end = _raw_end(page, name, at, last)
            if end >= 0:
                at = end
            elif name in ENDLESS:
                return
            else:
                unclosed.add(name)
            continue
        yield name, closing, attributes


def blocks(page: str | None) -> list[Block]:
    """Text blocks in page order: white space is one space, character references are decoded, blank ones are left out.

    Open and missing end tags are repaired as far as blocks need it.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    text: list[str] = []
    linked = depth = 0

    open_: Counter[str] = Counter()

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                levels = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                out.append(Block([m for _, marks in levels for m in marks], whole, linked))
            text.clear()
        linked = 0

    def close(at: int):
        open_.subtract(name for name, _ in stack[at:])
        del stack[at:]

    for name, closing, said in tokens(page or ""):
        if name is None:
            if not (stack and stack[-1][0] == "head"):
                text.append(said)
                if depth:
                    linked += len(said)
            continue
        if name not in PARTS:
            if name == "a":
                depth = 0 if closing else 1
            elif name in ("br", "wbr"):
                text.append(" ")
            continue
        flush()
        depth = 0
        if closing:
            if open_[name] > 0:
                close(next(at for at in range(len(stack) - 1, -1, -1) if stack[at][0] == name))
            continue
        if name in VOID:
            continue
        if name == "body":
            kept = [x for x in stack if x[0] == "html"]
            close(0)
            stack += kept
            open_.update(x for x, _ in kept)
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)  # any block ends an open paragraph
        ends = CLOSES.get(name, ())
        if any(open_[x] > 0 for x in ends):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in ends:
                    close(at)
                    break
                if stack[at][0] in _BOUNDARY:
                    break
        if not said.rstrip().endswith("/"):
            stack.append((name, [name, *_marks(said)]))
            open_[name] += 1
    flush()
    return out
