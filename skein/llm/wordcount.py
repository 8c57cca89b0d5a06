"""Token counts under a word-end BPE vocabulary, with a whole-token shortcut.

Before the texts are read, the merges are run over every vocabulary string that can stand as a pre-token: those which
come out as one token are proved to count one and are looked up. Only other pre-tokens are merged.

Defined results: null text is as empty (0 tokens); repeated rows are counted each; no truncation.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import CACHE_BYTES, SHORT_BYTES, Cache, RankQueue
from skein.llm.common import map_arrow, pieces

#: White space to ``str.split`` that Unicode doesn't call so.
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + k) for k in range(256 - len(kept)))
    return [chr(b) if b in kept else next(rest) for b in range(256)]


class Vocabulary:
    """Ranks of the merges of a tokenizer file; its normalizer and pre-tokenizer must be the ones handled here."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: not a lower-casing word-end BPE")
        self.findall = regex.compile(split["pattern"]["Regex"], regex.V0).findall
        self.suffix, ids = model["end_of_word_suffix"], model["vocab"]
        self.letters = byte_letters()
        self.ids = ids
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id << 20 | right id): (rank, id that it makes)
        self.pairs = {ids[a] << 20 | ids[b]: (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.single = self.prove()

    def parts(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        return [self.ids[x] for x in letters]

    def tokens(self, word: str) -> list[int]:
        """The ids of one pre-token by its merges."""
        parts = self.parts(word)
        return self._scan(parts) if len(parts) <= SHORT_BYTES else self._queue(parts)

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.pairs.get, (1 << 40, 0)
        waiting = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while waiting and (least := min(waiting)) is not none:
            i = waiting.index(least)
            ids[i] = least[1]
            del ids[i + 1], waiting[i]
            if i < len(waiting):
                waiting[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                waiting[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, get, queue = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get, RankQueue()
        for i in range(n - 1):
            if (found := get(ids[i] << 20 | ids[i + 1])) is not None:
                queue.push(found[0], i)
        while (least := queue.pop()) is not None:
            rank, i = least
            if ids[i] < 0 or (j := after[i]) >= n or (found := get(ids[i] << 20 | ids[j])) is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get(ids[i] << 20 | ids[k])) is not None:
                    queue.push(found[0], i)
            if (h := before[i]) >= 0 and (found := get(ids[h] << 20 | ids[i])) is not None:
                queue.push(found[0], h)
        return [x for x in ids if x >= 0]

    def prove(self) -> frozenset[str]:
        """The pre-tokens that are whole vocabulary strings and come out of the merges as that one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for name, number in self.ids.items():
            stem = name.removesuffix(self.suffix)
            if stem == name or any(c not in back for c in stem):
                continue
            try:
                word = bytes(back[c] for c in stem).decode()
            except UnicodeDecodeError:
                continue
            if word and self.tokens(word) == [number]:
                out.add(word)
        return frozenset(out)


class Counter:
    """Counts tokens; what it worked out for runs without white space and for pre-tokens is kept in bounded caches."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.runs, self.words = Cache(self.slow), Cache(lambda word: len(self.vocabulary.tokens(word)), CACHE_BYTES // 2)

    def forget(self) -> None:
        self.runs.forget()
        self.words.forget()

    def slow(self, text: str) -> int:
        """Tokens of text without special strings: normalised, split, whole tokens looked up and the rest merged."""
        text = _SPACE.sub(" ", unicodedata.normalize("NFC", text))
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letter by letter, whatever follows
        return sum(map(self.pretoken, self.vocabulary.findall(text.lower())))

    def pretoken(self, word: str) -> int:
        return 1 if word in self.vocabulary.single else self.words[word]

    def count(self, text: str) -> int:
        special = self.vocabulary.special
        if special is not None and special.search(text):
            found = special.split(text)
            return len(found) // 2 + sum(map(self.plain, found[::2]))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if _CONTROLS.search(text):
            return self.slow(text)
        return sum(map(self.runs.__getitem__, text.split()))


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row."""
    narrow = docs.select(F.col(key), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        try:
            for batch, column in pieces(batches):
                n = pa.array([counter.count(x.decode()) for x in column.to_pylist()], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(column).cast(pa.int64()), n], names=[key, "n_bytes", "n_tokens"])
        finally:
            counter.forget()

    return map_arrow(narrow, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
