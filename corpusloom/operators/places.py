"""PJ27: where each character that readers see of a block stands in its Markdown.

The block is rewritten as markdown.render_block and norm.reader_text do, step by step, with the place of every character carried
along: a step takes marks out or puts one character for several, and what is left keeps its place. So a reader's text and its places
come from the block's own marks, not from a comparison of the two texts."""

import re
from dataclasses import dataclass

from corpusloom.operators.alignment import blocks, gaps


@dataclass
class Seen:
    """Characters with the part of the source, from start to stop, that each stands for."""

    text: str
    starts: list[int]
    stops: list[int]

    @classmethod
    def whole(cls, source: str) -> "Seen":
        return cls(source, list(range(len(source))), list(range(1, len(source) + 1)))

    def parts(self, *ranges: tuple[int, int]) -> "Seen":
        every = [k for a, b in ranges for k in range(a, b)]
        return Seen("".join(self.text[k] for k in every), [self.starts[k] for k in every], [self.stops[k] for k in every])

    def without(self, pattern: str, keep: int | None = None) -> "Seen":
        """Matches taken out, but for a group of them."""
        at, ranges = 0, []
        for m in re.finditer(pattern, self.text):
            ranges.append((at, m.start()))
            if keep is not None:
                ranges.append(m.span(keep))
            at = m.end()
        return self.parts(*ranges, (at, len(self.text)))

    def as_one(self, pattern: str, to) -> "Seen":
        """Each match as one character."""
        at, text, starts, stops = 0, [], [], []
        for m in re.finditer(pattern, self.text):
            a, b = m.span()
            text += [self.text[at:a], to(m)]
            starts += [*self.starts[at:a], self.starts[a]]
            stops += [*self.stops[at:a], self.stops[b - 1]]
            at = b
        return Seen("".join(text) + self.text[at:], starts + self.starts[at:], stops + self.stops[at:])


#: Private characters that stand for escaped marks until all marks are out.
ESCAPED = {"*": "\ue000", "_": "\ue001", "[": "\ue002", "]": "\ue003"}


def reader_places(source: str) -> Seen:
    """What readers see of a block."""
    seen = Seen.whole(source)
    if re.match(r"---\Z", source):
        return seen.parts()
    if head := re.match(r"### |## ", source):
        seen = seen.parts((head.end(), len(source)))
    elif not source.startswith("![") and re.match(r"[-*]\s", source):
        # Items begin lines; other lines go on with the item before.
        seen = seen.as_one(r"[ \t]*\n[ \t]*", lambda m: "\n").without(r"(?:\A|\n)[-*]\s+")
    elif source.startswith("> "):
        seen = seen.without(r"\n\s*\n").without(r"(?m)^>[ \t]?") if not re.search(r"\n\s*\n", source) else _paragraphs(seen)
    if not re.match(r"### |## |!\[", source):
        seen = seen.as_one(r"\n", lambda m: " ")  # elsewhere marks don't go on in the next line
    seen = seen.as_one(r"\\([*_\[\]])", lambda m: ESCAPED[m[1]]).without(r"\[\^\w+\]")
    seen = seen.without(r"!\[[^\n]*?\]\([^\n]*?\)").without(r"\[([^\[\]]+?)\]\([^)]+?\)", 1)
    seen = seen.without(r"\*\*([^\n]+?)\*\*", 1).without(r"\*([^\n]+?)\*", 1)
    seen = seen.as_one("[" + "".join(ESCAPED.values()) + "]", lambda m: {v: k for k, v in ESCAPED.items()}[m[0]])
    seen = seen.as_one(r"\s+", lambda m: " ")
    return seen.without(r"\A | \Z")


def _paragraphs(seen: Seen) -> Seen:
    """A quotation's paragraphs, which follow each other without a space."""
    ranges, at = [], 0
    for m in re.finditer(r"\n\s*\n", seen.text):
        ranges.append((at, m.start()))
        at = m.end()
    parts = [seen.parts(r).without(r"(?m)^>[ \t]?") for r in [*ranges, (at, len(seen.text))]]
    return Seen("".join(p.text for p in parts), [x for p in parts for x in p.starts], [x for p in parts for x in p.stops])


def _common(a: str, b: str) -> int:
    """How many characters both begin with."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def edited(source: str | None, old: str | None, new: str | None) -> str | None:
    """source with the runs of its reader's text `old` that `new` has otherwise put in their places, the last first. Null if `old` isn't
    what readers see, or if a run's places are out of order."""
    if source is None or old is None or new is None:
        return None
    seen = reader_places(source)
    if seen.text != old:
        return None
    starts = [*seen.starts, len(source)]
    # What both begin and end with stays as it is, so that marks around recurring words are not moved.
    head = _common(old, new)
    tail = _common(old[head:][::-1], new[head:][::-1])
    inner = blocks(old[head : len(old) - tail], new[head : len(new) - tail])
    same = [(0, 0, head), *((i + head, j + head, n) for i, j, n in inner), (len(old) - tail, len(new) - tail, tail)]
    for i, x, j, y in reversed(list(gaps([b for b in same if b[2]], (len(old), len(new))))):
        start, stop = starts[i], seen.stops[x - 1] if x > i else starts[i]
        if start > stop:
            return None
        source = source[:start] + new[j:y] + source[stop:]
    return source
