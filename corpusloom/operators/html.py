"""Web pages as blocks with marks and note anchors. Nesting of elements needs a parser, so pages go through Arrow batches."""

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content, elements that open a block, elements and classes that readers do not read as text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "p", "pre", "ul"}
SKIPPED = {"audio", "button", "figure", "noscript", "picture", "script", "style", "svg", "video"}
SKIPPED_CLASSES = {
    "button-wrapper", "captioned-image-container", "comments-section", "digest-post-embed", "embedded-post", "embedded-post-wrap", "footnote-number", "image-link",
    "native-video-embed", "paywall", "poll", "pullquote", "share-dialog", "subscribe-widget", "subscription-widget", "subscription-widget-wrap", "subscription-widget-wrap-editor", "tweet",
}
KINDS = {"em": "em", "i": "em", "strong": "strong", "b": "strong", "a": "link"}

TOKEN = re.compile(r"<!--.*?-->|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RUN = "struct<start:int,end:int,kind:string,text:string,href:string>"
BLOCKS = f"array<struct<kind:string,text:string,marks:array<{RUN}>,anchors:array<struct<at:int,label:string>>>>"


def _href(url: str) -> str:
    return url[:-1] if url.endswith("/") and url.count("/") > 3 else url


class _Painted:
    """A block's characters, each with the marks that cover it: maximal runs of one mark are its runs, however many elements
    they came from."""

    def __init__(self, kind: str):
        self.kind, self.chars, self.paint, self.anchors = kind, [], [], []

    def add(self, text: str, marks: frozenset) -> None:
        for c in text:
            if c.isspace():
                if not self.chars or self.chars[-1] == " ":
                    # A swallowed space must not part two runs that touch.
                    continue
                c = " "
            self.chars.append(c)
            self.paint.append(marks)

    def done(self) -> tuple | None:
        text = "".join(self.chars).rstrip()
        runs = []
        for mark in set().union(*self.paint) if self.paint else ():
            at = 0
            while at < len(self.paint):
                start = at
                while at < len(self.paint) and mark in self.paint[at]:
                    at += 1
                inside = "".join(self.chars[start:at])
                if inside.strip():
                    first = start + len(inside) - len(inside.lstrip())
                    runs.append((first, first + len(inside.strip()), mark[0], inside.strip(), mark[1]))
                at += at == start
        runs.sort(key=lambda r: (r[0], -r[1], r[2], r[4]))
        return (self.kind, text, runs, [(min(a, len(text)), label) for a, label in self.anchors]) if text else None


def page_blocks(page: str | None) -> list[tuple]:
    """PJ9, PJ13: blocks in order. Only the outermost block element opens one; notes have the kind `note`; adjacent
    blockquotes stay apart. Elements that were never closed end with the page. Null or empty: none."""
    out, open_, block, label = [], [], None, None
    for m in TOKEN.finditer(page or ""):
        if m["text"] is not None:
            if any(e["skip"] for e in open_):
                continue
            text = html.unescape(m["text"])
            if label is not None:
                label.append(text)
            elif block is not None:
                block.add(text, frozenset(e["mark"] for e in open_ if e["mark"]))
            continue
        tag = (m["tag"] or "").lower()
        if not tag or tag in VOID:
            continue
        if not m["end"]:
            attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m["rest"])}
            classes = set(attributes.get("class", "").split())
            e = {"tag": tag, "skip": tag in SKIPPED or bool(classes & SKIPPED_CLASSES), "mark": None, "opens": False, "anchor": "footnote-anchor" in classes, "note": "footnote" in classes}
            hidden = any(x["skip"] for x in open_) or e["skip"]
            if not hidden and e["anchor"]:
                label = []
            elif not hidden and "footnote-content" in classes:
                block, e["opens"] = _Painted("note"), True
            elif not hidden and tag in BLOCK and block is None and not any(x["note"] for x in open_):
                block, e["opens"] = _Painted(tag), True
            elif not hidden and block is not None and tag in KINDS:
                e["mark"] = (KINDS[tag], _href(attributes.get("href", "")) if tag == "a" else "")
            if not m["rest"].rstrip().endswith("/"):
                open_.append(e)
        elif any(e["tag"] == tag for e in open_):
            while True:
                e = open_.pop()
                if e["anchor"] and label is not None:
                    if block is not None:
                        block.anchors.append((len(block.chars), "".join(label).strip()))
                    label = None
                if e["opens"] and block is not None:
                    out.append(block.done())
                    block = None
                if e["tag"] == tag:
                    break
    if block is not None:
        out.append(block.done())
    return [b for b in out if b]


_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("href", pa.string())])
_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("marks", pa.list_(_RUN)), ("anchors", pa.list_(pa.struct([("at", pa.int32()), ("label", pa.string())])))]))
#: Pages that are held as Python objects at once.
HELD = 64


def _parsed(pages: pa.Array) -> pa.Array:
    names, out = ("start", "end", "kind", "text", "href"), []
    for i in range(0, len(pages), HELD):
        made = [[{"kind": k, "text": t, "marks": [dict(zip(names, r, strict=True)) for r in runs], "anchors": [{"at": a, "label": x} for a, x in anchors]} for k, t, runs, anchors in page_blocks(p.as_py())] for p in pages.slice(i, HELD)]
        out.append(pa.array(made, _BLOCKS))
    return pa.concat_arrays(out) if out else pa.array([], _BLOCKS)


def blocks_of(page: Column) -> Column:
    """PJ13: the array of a page's blocks. Batches are Arrow's on both sides, as Python objects would be many times their size."""
    return F.arrow_udf(_parsed, BLOCKS)(page)


def mark_keys(marks: Column) -> Column:
    """PJ10: what two blocks' marks are compared by: kinds, texts and addresses, not offsets."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws("|", m["kind"], m["text"], m["href"])), "\x01")


def anchor_tails(block: Column, length: int = 40) -> Column:
    """PJ11: each anchor's label and the last characters before it."""
    return F.transform(block["anchors"], lambda a: F.struct(a["label"].alias("label"), F.right(F.substring(block["text"], F.lit(1), a["at"]), F.lit(length)).alias("tail")))


def captions(page: Column) -> Column:
    """PJ14: a caption for each figure, empty if it has none."""
    figures = F.regexp_extract_all(page, F.lit(r"(?is)<figure\b.*?</figure>"), F.lit(0))
    return F.transform(figures, lambda f: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(f, r"(?is)<figcaption[^>]*>(.*?)</figcaption>", 1), "<[^>]+>", ""), r"\s+", " ")))
