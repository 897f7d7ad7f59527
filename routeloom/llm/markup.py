"""HTML as a run of texts and tags: names are whole, quoted attribute values may hold `>`, raw-text elements are skipped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
#: Elements whose content is no markup: it ends at their own end tag, or with the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that may close themselves.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def tokens(page: str, raw: frozenset[str] = RAW) -> Iterator[tuple[str, str | None, bool, str]]:
    """(text before, tag name in lower case or None, whether it is an end tag, attributes); comments and declarations have no name.

    The content of `raw` elements is skipped.  A tag cut off at the page's end is dropped.  The last one has the rest of the text and no name.
    """
    at = 0
    while m := _TOKEN.search(page, at):
        name = m[2].lower() if m[2] else None
        yield page[at : m.start()], name, bool(m[1]), m[3] or ""
        at = m.end()
        if name in raw and not m[1]:
            end = _end_of(name).search(page, at)
            at = end.start() if end else len(page)
    yield page[at:], None, False, ""


class Hidden:
    """Whether the place in a page lies in an element that isn't shown, as its tags pass by.

    An element that isn't closed ends with the one around it.
    """

    def __init__(self, names: frozenset[str]):
        self.names, self.open = names, []

    def passed(self, name: str, closing: bool, attrs: str, around: list[str]) -> bool:
        """Takes a tag; true if it belongs to a hidden element.  `around`: names of the shown elements that are open."""
        if self.open:
            if not closing:
                if name not in VOID and not attrs.endswith("/"):
                    self.open.append(name)
            elif name in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(name) :]
            elif name in around:  # what encloses the hidden element ends, and so does that
                self.open.clear()
                return False
            return True
        if name in self.names:
            if not closing and not (attrs.endswith("/") and name in FOREIGN):
                self.open.append(name)
            return True
        return False
