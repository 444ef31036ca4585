"""Cutting texts at blanks where no tokenizer rule reaches across, and bounded caches over the pieces."""

from __future__ import annotations

import re
#: White space of any rule in use: that of Unicode and the four separators that Python counts too.
SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
_BESIDE = re.compile(f" [{SPACE}]|[{SPACE}] ")
_LONE = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def lone_blanks(text: str) -> list[str]:
    """The pieces between single blanks that have no white space beside them, without these blanks."""
    if text[:1] != " " and text[-1:] != " " and not _BESIDE.search(text):
        return text.split(" ")
    return _LONE.split(text)


class Known(dict):
    """What was looked up lately: when `most` entries are in, they become the older half and new ones are gathered."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set) -> set:
        """The keys known to neither half; those of the older one are taken over."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = keys.difference(self)
        if self.older:
            again = out.intersection(self.older)
            self.update((k, self.older[k]) for k in again)
            out -= again
        return out
