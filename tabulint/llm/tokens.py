"""Exact token counts of a byte-level BPE tokenizer, with a whole-token shortcut.

Most pre-tokens of a text are themselves vocabulary strings.  Not every
vocabulary string encodes alone as itself, though: the merges may never build
it.  So every vocabulary string is encoded alone by the merges, once and before any
text is read, and those proved to come out as one token form a table that is
broadcast.  A pre-token in the table counts one without merging; only the rest go
through the merges.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The byte-level pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks where every released Unicode version agrees on letters, digits and
#: spaces.  Texts with other characters are split by the tokenizer's own
#: pre-tokenizer, whose Unicode tables may be older than those of `regex`.
SETTLED = regex.compile(r"[\u0000-՗ -⁯₠-₿℀-⅏←-⋿　-〩ぁ-ゖ゠-ヿ一-龥가-힣]*+")
#: Merge counts remembered per worker before they are forgotten (about 100 MB).
REMEMBERED = 1_000_000
#: Code points below which a text takes the plain `re` form of the pattern.
LATIN = 0x250


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


def latin_pattern() -> str:
    """PATTERN with its classes listed out, for texts of code points below LATIN."""
    letters, digits = ("".join(chr(i) for i in range(LATIN) if regex.match(p, chr(i))) for p in (r"\p{L}", r"\p{N}"))
    spaces = "\t-\r \x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Join neighbours by rank, leftmost first among equals, with a heap: a
    pre-token of n bytes takes n log n steps."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if not gone[i] else -1
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], gone[j], right[i] = a + b, 1, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for p, q in ((left[i], i), (i, right[i])):
            if p >= 0 and q >= 0 and (r := ranks.get((symbols[p], symbols[q]))) is not None:
                heapq.heappush(heap, (r, p, symbols[p], symbols[q]))
    return [s for s, g in zip(symbols, gone) if not g]


def loaded(path: str) -> dict:
    """The tokenizer's file; an error if it asks for what is not done here: another
    model, a normaliser, or added tokens that take white space or whole words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    odd = [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or odd:
        raise ValueError(f"{path} is no plain byte-level BPE file" + f" (added tokens {odd})" * bool(odd))
    return spec


def ranked(spec: dict) -> dict[tuple[str, str], int]:
    return {tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)): i for i, m in enumerate(spec["model"]["merges"])}


def proved(path: str) -> list[str]:
    """The vocabulary strings that the merges make one token of."""
    spec = loaded(path)
    ranks, back, out = ranked(spec), {c: b for b, c in byte_letters().items()}, []
    for v in spec["model"]["vocab"]:
        try:
            s = bytes(back[c] for c in v).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(merge(list(v), ranks)) == 1:
            out.append(s)
    return out


class Counter(dict):
    """Tokens of a pre-token; a missing one is merged and remembered.  `known`: those
    proved to be one token."""

    def __init__(self, path: str, known: list[str]):
        super().__init__(dict.fromkeys(known, 1))
        spec = loaded(path)
        self.path, self.letters, self.ranks = path, byte_letters(), ranked(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find, self.find_latin = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        self.beyond_latin = re.compile(f"[^\\0-{chr(LATIN - 1)}]").search
        self.own = None
        self.proved = dict(self)

    def __missing__(self, piece: str) -> int:
        n = len(merge([self.letters[b] for b in piece.encode()], self.ranks))
        if len(self) > len(self.proved) + REMEMBERED:
            self.clear()
            self.update(self.proved)
        if len(piece) < 100:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if not self.beyond_latin(text):
            return self.find_latin(text)
        if SETTLED.fullmatch(text):
            return self.find(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_LOADED: dict[str, Counter] = {}


def counter(path: str, known: list[str]) -> Counter:
    """The worker's counter for a file."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path, known)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_bytes (UTF-8), n_tokens and over_limit.

    tokenizer: path of a byte-level BPE file of the `tokenizers` library, there
    on every executor.  One scan, no shuffle.  A null or empty text has 0 bytes
    and 0 tokens; repeated rows stay as many rows; added tokens' strings, special or
    not, inside a text count as that token, which is the library's default.  Texts of
    any length are read whole, one after the other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proved(tokenizer))
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def run(parts):
        c = counter(tokenizer, shared.value)
        for p in parts:
            texts = p.column(len(keep))
            size = [len(t.encode()) if t else 0 for t in (x.as_py() for x in texts)]
            n = [c.count(t) if t else 0 for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(keep))), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=out.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
