"""A light element tree of one page: labels of controls, labels of shown values, and text that style sheets add.

Walks are iterative and reads of an element's text stop at the length that
matters, so a deep or huge page costs little more than its parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Limits of labels and values, and which open elements a new one closes.
FIELD_LABEL, SHOWN_LABEL, SHOWN_WORDS, SHOWN_VALUE, SHOWN_CHILDREN, CLIMB = 80, 40, 5, 160, 4, 3
CONTROLS = frozenset("input select textarea".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
CLOSED_BY |= dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot", "tr", "td", "th"})
SCOPES = frozenset("ul ol dl table select body html".split())
MASKED = re.compile("[X*•]{4}", re.I)


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids", "pos", "prev", "hidden", "controls", "has_button", "cells", "cell", "first_row", "n_elements", "number", "own")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, number: int) -> None:
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.kids: list[Element | str] = []
        self.cells: list[Element] = []
        self.prev = self.first_row = None
        self.hidden = self.has_button = False
        self.controls = self.n_elements = self.pos = self.cell = 0
        self.own: str | None | bool = False
        if parent is None:
            return
        self.hidden, self.pos = parent.hidden, len(parent.kids)
        if parent.n_elements:
            self.prev = next(k for k in reversed(parent.kids) if isinstance(k, Element))
        parent.n_elements += 1
        if tag in ("td", "th"):
            self.cell = len(parent.cells)
            parent.cells.append(self)
        parent.kids.append(self)

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent


def text_of(e: Element | str, limit: int | None = None) -> str | None:
    """All text below, blanks collapsed; None as soon as it is longer than the limit."""
    words, length, waiting, glue = [], 0, [e], False
    while waiting:
        x = waiting.pop()
        if isinstance(x, Element):
            waiting += reversed(x.kids)
            continue
        parts = x.split()
        if not parts:
            glue = glue and not x
            continue
        if glue and words and not x[0].isspace():
            words[-1] += parts[0]
            length += len(parts[0])
            parts = parts[1:]
        words += parts
        length += sum(map(len, parts)) + len(parts)
        glue = not x[-1].isspace()
        if limit is not None and length - 1 > limit + 1:
            return None
    text = " ".join(words)
    return None if limit is not None and len(text) > limit else text


def control_label(e: Element) -> str:
    """The nearest text before a control inside its own container: up to three containers, not past another control."""
    node = e
    for _ in range(CLIMB):
        box = node.parent
        if box is None:
            break
        for i in range(node.pos - 1, -1, -1):
            kid = box.kids[i]
            if isinstance(kid, Element) and (kid.tag in CONTROLS or kid.controls):
                return ""
            text = text_of(kid, FIELD_LABEL)
            if text is None:
                return ""
            if text:
                return text
        if box.controls > 1:
            break
        node = box
    return ""


def _label_like(text: str | None) -> bool:
    return bool(text) and len(text) <= SHOWN_LABEL and len(text.split()) <= SHOWN_WORDS


def shown_label(e: Element) -> str:
    """What names a shown value: the term of a description, a column's header, or the short text before it."""
    if e.tag == "dd":
        before = e.prev
        while before is not None and before.tag != "dt":
            before = before.prev
        return text_of(before) if before is not None else ""
    if e.tag == "td":
        table = next((a for a in e.ancestors() if a.tag == "table"), None)
        head = table.first_row if table is not None else None
        if head is not None and head is not e.parent and e.cell < len(head.cells) and head.cells[e.cell].tag == "th":
            return text_of(head.cells[e.cell])
    elif e.prev is not None and (e.prev.controls or e.prev.has_button):
        return ""
    text = text_of(e.prev, SHOWN_LABEL) if e.prev is not None else ""
    return text if _label_like(text) else ""


def value_candidates(owner: Element) -> Iterator[tuple[int, int, str, str]]:
    """(steps up, element, label, own text) of the element that holds a text and the two around it."""
    e, step = owner, 0
    while e is not None and step < CLIMB:
        if e.own is False:
            e.own = None
            if e.n_elements <= SHOWN_CHILDREN and e.parent is not None:
                own = text_of(e, SHOWN_VALUE)
                label = shown_label(e) if own and not MASKED.search(own) else ""
                e.own = (label, own) if label else None
        if e.own:
            yield step, e.number, *e.own
        e, step = e.parent, step + 1


_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_PSEUDO = re.compile(r"::?(before|after)\s*\Z", re.I)
_CONTENT = re.compile(r"""(?:^|;)\s*content\s*:((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^;"'])*)""", re.I)
_PIECE = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|attr\(\s*([\w-]+)\s*\)""")
_SIMPLE = re.compile(r"([.#]?)([\w-]+|\*)")
_STRIP = re.compile(r"\[[^\]]*\]|:[\w-]+(?:\([^)]*\))?")


def generated_rules(css: str) -> dict[str, list]:
    """Rules that add text before or after elements, by the most selective name in their last part.

    Conditions on ancestors, attributes and states are not checked: a rule may
    apply to more elements than painted, never to fewer.
    """
    out: dict[str, list] = {}
    for order, m in enumerate(_RULE.finditer(_COMMENT.sub(" ", css))):
        content = _CONTENT.search(m[2])
        if not content:
            continue
        for selector in m[1].split(","):
            side = _PSEUDO.search(selector.strip())
            if not side:
                continue
            last = re.split(r"[\s>+~]+", _STRIP.sub("", selector.strip()[: side.start()]).strip())[-1] or "*"
            names = [a + (b.lower() if not a else b) for a, b in _SIMPLE.findall(last) if b != "*"]
            ids, classes = (sum(n.startswith(c) for n in names) for c in "#.")
            key = min(names, key=lambda n: {"#": 0, ".": 1}.get(n[0], 2), default="*")
            out.setdefault(key, []).append((side[1].lower(), frozenset(names), (ids, classes, len(names), order), content[1]))
    return out


def generated_text(e: Element, rules: dict[str, list]) -> str:
    names = [e.tag, *("." + c for c in e.attrs.get("class", "").split()), *(["#" + e.attrs["id"]] if e.attrs.get("id") else [])]
    known, best = set(names), {}
    for key in ("*", *names):
        for side, needs, weight, content in rules.get(key, ()):
            if needs <= known and (side not in best or best[side][0] < weight):
                best[side] = weight, content
    texts = []
    for side in ("before", "after"):
        content = best.get(side, (0, ""))[1]
        texts.append("".join(e.attrs.get(m[3], "") if m[3] else re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2]) for m in _PIECE.finditer(content)))
    return " ".join(texts) if any(t.strip() for t in texts) else ""
