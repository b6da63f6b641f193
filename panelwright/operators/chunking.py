"""Markdown texts as chunks of bounded size: cut at headings outside of fences, long parts split at sentences, small ones packed together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"\s*(```+|~~~+)")
LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
MARKS = re.compile(r"(\*\*|__|`)")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CHUNKS = "array<struct<title:string,text:string,words:int>>"
#: Words a chunk should have at least and has at most, and characters of a title.
LEAST, MOST, TITLE = 40, 220, 160


def sections(text: str) -> Iterator[tuple[str, str]]:
    """The heading path of each section and its body; a heading without a body has no section, and none is found within a fence, which a fence of
    the same kind ends."""
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fence = None

    def told():
        return " > ".join(name for _, name in path), "\n".join(body).strip()

    for line in text.split("\n"):
        mark = FENCE.match(line)
        if mark:
            kind = mark[1][:3]
            fence = kind if fence is None else None if fence == kind else fence
        head = HEADING.match(line) if fence is None and not mark else None
        if head is None:
            body.append(line)
            continue
        if any(x.strip() for x in body):
            yield told()
        body = []
        level = len(head[1])
        path = [p for p in path if p[0] < level] + [(level, head[2])]
    if any(x.strip() for x in body):
        yield told()


def plain(text: str) -> str:
    """text without the targets of links and the marks of emphasis and code."""
    return MARKS.sub("", LINK.sub(r"\1", text))


def pieces(text: str, most: int) -> Iterator[str]:
    """Parts of text of at most most words, cut at ends of sentences where they allow it."""
    held: list[str] = []
    n = 0
    for sentence in SENTENCE.split(text):
        words = sentence.split()
        while words:
            if n and n + len(words) > most:
                yield " ".join(held)
                held, n = [], 0
            if len(words) > most:
                yield " ".join(words[:most])
                words = words[most:]
                continue
            held.append(" ".join(words))
            n += len(words)
            break
    if held:
        yield " ".join(held)


def chunks(text: str | None, least: int = LEAST, most: int = MOST) -> list[dict]:
    """Chunks of at most most words; one has fewer than least only if the next could not be added to it, or it is the last."""
    out: list[dict] = []
    for title, body in sections(text or ""):
        for piece in pieces(plain(body), most):
            n = len(piece.split())
            last = out[-1] if out else None
            if last is None or last["words"] >= least or last["words"] + n > most:
                out.append({"titles": [title] if title else [], "texts": [piece], "words": n})
            else:
                last["texts"].append(piece)
                last["words"] += n
                if title and title not in last["titles"]:
                    last["titles"].append(title)
    return [{"title": "; ".join(c["titles"])[:TITLE], "text": "\n\n".join(c["texts"]), "words": c["words"]} for c in out]


def chunked(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """chunks() of a text column, an array of title, text and words; empty for null and empty texts."""
    kind = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("words", pa.int32())]))

    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t.as_py(), least, most) for t in texts], kind)

    return run(text)
