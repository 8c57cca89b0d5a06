"""Packing paragraphs into chunks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 600
_WORDS = re.compile(r"\w+|[^\w\s]")
_STOP = re.compile(r"(?<=[.!?])\s+(?=[^\s])")
_SHORT = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|St|vs|etc|e\.g|i\.e|No|Fig|Inc|Ltd|Co)|\b[A-Z])\.$")


def count_words(text: str) -> int:
    return len(_WORDS.findall(text))


def sentences(text: str) -> list[str]:
    """Sentences; a stop behind a known abbreviation or an initial doesn't end one."""
    out: list[str] = []
    for part in _STOP.split(text.strip()):
        if out and _SHORT.search(out[-1]):
            out[-1] += " " + part
        elif part:
            out.append(part)
    return out


def split_long(text: str, size: int, count: Callable[[str], int]) -> list[str]:
    """The text in parts of at most ``size``: by sentences, then by words, and a single longer word as it is."""
    if count(text) <= size:
        return [text]
    parts = sentences(text)
    if len(parts) == 1:
        words = text.split()
        if len(words) == 1:
            return [text]
        middle = len(words) // 2
        parts = [" ".join(words[:middle]), " ".join(words[middle:])]
    out: list[str] = []
    for part in parts:
        for piece in split_long(part, size, count):
            if out and count(out[-1] + " " + piece) <= size:
                out[-1] += " " + piece
            else:
                out.append(piece)
    return out


def pack(units: list[tuple[str, str]], size: int = SIZE, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of units (kind, text), kind heading, table or text: what would overflow begins a new chunk, a table stands alone,
    a heading stays with what follows it, and a chunk of headings only is left out."""
    chunks: list[str] = []
    held: list[tuple[str, str]] = []

    def flush() -> None:
        if any(kind != "heading" for kind, _ in held):
            chunks.append("\n\n".join(t for _, t in held))
        held.clear()

    for kind, text in units:
        if kind == "table":
            flush()
            chunks.append(text)
            continue
        for piece in split_long(text, size, count):
            if held and sum(count(t) for _, t in held) + count(piece) > size:
                flush()
            held.append((kind, piece))
    flush()
    return chunks


def packed(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, chunk_text): a document's lines packed; each task takes whole documents, one at a time."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = []
            for i, t in zip(frame[key], frame[text]):
                units = []
                for line in (t or "").split("\n"):
                    if line.strip():
                        units.append(("heading" if line.startswith("#") else "table" if line.count("|") > 1 else "text", line.strip()))
                rows += [(i, n, c) for n, c in enumerate(pack(units, size))]
            yield pd.DataFrame(rows, columns=[key, "position", "chunk_text"])

    return docs.select(F.col(key), F.col(text)).mapInPandas(run, f"`{key}` {kind}, position long, chunk_text string")
