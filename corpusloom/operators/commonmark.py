"""FL12: what a strict reading of Markdown leaves of its marks: asterisks that readers would see, and ticks beside a letter.

A block's inline text is scanned once into tokens: text, runs of * and _ with what they can do by the characters beside them, and
brackets. Code, addresses in angle brackets and tags take their asterisks with them; a link or an image closes over its brackets, its
destination is not seen, and an image's text neither. Runs then close each other from a stack: a closer takes the nearest opener
of its character (the rule of three sets some apart), what stands between them stays as it is, two of a run make strong emphasis.
Asterisks that no emphasis has taken are stray.

Each block is a row, so a text is as large as its blocks; a block's scan is linear but for the openers that a closer passes, of which the
least ones passed in vain are remembered."""

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a letter between a tick and no other tick.
LETTER = r"(?<![`\w])`([^\W\d_][̀-ͯ]*)(?![`\w])"
#: Autolinks and tags in running text.
AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+>")
TAG = re.compile(r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!--.*?-->|<\?.*?\?>|<![A-Z]+\s[^>]*>", re.S)
DESTINATION = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
TICKS = re.compile("`+")
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _space(c: str) -> bool:
    return not c or c.isspace()


def _mark(c: str) -> bool:
    return c in PUNCTUATION or bool(c) and unicodedata.category(c)[0] in "PS"


@dataclass
class Run:
    """A run of one character: how many of it are left, and whether it can open or close."""

    char: str
    left: int
    opens: bool
    closes: bool
    size: int = 0


def _run(text: str, at: int, size: int) -> Run:
    char, before, after = text[at], text[at - 1 : at], text[at + size : at + size + 1]
    left = not _space(after) and (not _mark(after) or _space(before) or _mark(before))
    right = not _space(before) and (not _mark(before) or _space(after) or _mark(after))
    if char == "*":
        return Run(char, size, left, right, size)
    return Run(char, size, left and (not right or _mark(before)), right and (not left or _mark(after)), size)


def emphasized(runs: list[Run]) -> None:
    """Takes from the runs what becomes emphasis."""
    vain: dict = {}
    k = 0
    while k < len(runs):
        closer = runs[k]
        if not closer.closes or not closer.left:
            k += 1
            continue
        kind = closer.char, closer.opens, closer.size % 3
        at = k - 1
        while at >= vain.get(kind, 0):
            opener = runs[at]
            three = (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
            if opener.char == closer.char and opener.opens and opener.left and not three:
                break
            at -= 1
        else:
            vain[kind] = k
            k += 1
            continue
        used = 2 if opener.left >= 2 and closer.left >= 2 else 1
        opener.left -= used
        closer.left -= used
        for between in runs[at + 1 : k]:
            between.opens = between.closes = False


def stray(block: str) -> int:
    """How many asterisks of a block's running text no emphasis, code, address or tag takes; escaped ones are meant."""
    runs: list[Run] = []
    #: Open brackets: how many runs stood before, whether an image's, whether a link may begin there.
    brackets: list[list] = []
    hidden = 0
    at, size = 0, len(block)
    unclosed: set[int] = set()
    while at < size:
        c = block[at]
        if c == "\\" and at + 1 < size and block[at + 1] in PUNCTUATION:
            at += 2
        elif c == "`":
            ticks = TICKS.match(block, at)
            n = len(ticks[0])
            end = -1
            if n not in unclosed:
                end = next((m.end() for m in TICKS.finditer(block, ticks.end()) if len(m[0]) == n), -1)
            if end < 0:
                unclosed.add(n)
            at = end if end > 0 else ticks.end()
        elif c == "<" and (m := AUTOLINK.match(block, at) or TAG.match(block, at)):
            at = m.end()
        elif c in "*_":
            n = 1
            while at + n < size and block[at + n] == c:
                n += 1
            runs.append(_run(block, at, n))
            at += n
        elif c == "[" or c == "!" and block[at + 1 : at + 2] == "[":
            brackets.append([len(runs), c == "!", True])
            at += 1 + (c == "!")
        elif c == "]" and brackets:
            first, image, active = brackets.pop()
            m = DESTINATION.match(block, at + 1) if active else None
            if m:
                inner = runs[first:]
                emphasized(inner)
                if not image:
                    hidden += sum(r.left for r in inner if r.char == "*")
                    for b in brackets:
                        b[2] = b[2] and b[1]  # no links in links
                del runs[first:]
            at = m.end() if m else at + 1
        else:
            at += 1
    emphasized(runs)
    return hidden + sum(r.left for r in runs if r.char == "*")


def stray_in_block(block: str) -> int:
    """Of a block of a draft: its rules, bullets, headings' and quotations' marks are none of its text, indented code is not read."""
    if re.match(r"(?: {4}|\t)", block):
        return 0
    kept: list[str] = []
    total = 0

    def flush() -> int:
        n = stray("\n".join(kept))
        kept.clear()
        return n

    for line in block.split("\n"):
        line = re.sub(r"\A {0,3}(?:> ?)+", "", line)
        if re.match(r" {0,3}([*_-])[ \t]*(?:\1[ \t]*){2,}\Z", line):
            total += flush()
        elif m := re.match(r" {0,3}(?:[*+-]|\d{1,9}[.)])(?:[ \t]+|\Z)(.*)", line, re.S):
            total += flush()
            kept.append(m[1])
        elif m := re.match(r" {0,3}#{1,6}(?:[ \t]+(.*)|\Z)", line, re.S):
            total += flush() + stray(m[1] or "")
        else:
            kept.append(line.strip())
    return total + flush()


def strict_marks(blocks: DataFrame, text: str = "src") -> DataFrame:
    """Blocks (one text each) with `stars`, the asterisks that a strict reading leaves, and `tick`, whether a letter stands behind a tick
    that no other tick closes in its line; those that have either. A null block has none."""

    @F.pandas_udf("int")
    def stars(column: pd.Series) -> pd.Series:
        return column.map(lambda b: stray_in_block(b) if b and "*" in b else 0)

    tick = F.col(text).rlike(rf"(?U){LETTER}(?![^\n]*`)")
    return blocks.withColumns({"stars": stars(F.coalesce(text, F.lit(""))), "tick": F.coalesce(tick, F.lit(False))}).where("stars > 0 OR tick")
