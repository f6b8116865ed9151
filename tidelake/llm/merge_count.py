"""Token counts by heap-and-linked-list byte-pair merging.

For each piece of text the symbols, at first its bytes, form a linked list; a heap gives
the adjacent pair of lowest rank, leftmost first, until none is left. The count is the
number of bytes less the number of merges; no token ids are made. Counts of parts
are remembered in each Python worker.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed values of byte-level vocabulary files: how a text is cut into pieces, and the characters that stand for bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for pure ASCII, which the re module cuts faster.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
REMEMBERED = 1 << 20  # parts a worker remembers before it starts afresh
_WIDE, _END, _GONE = 1 << 32, 1 << 31, -1  # above any id; what follows the last symbol; a symbol that was merged into the one before


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 as it is, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(0x100 + extra), extra + 1
    return out


class Merges:
    """Ranks of a byte-level BPE vocabulary file; count() counts the tokens of a text."""

    def __init__(self, path: str):
        import regex

        data = json.load(open(path, encoding="utf-8"))
        model = data["model"]
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        ids = model["vocab"]
        self.first = [ids[c] for c in byte_characters()]
        #: The rank of a pair of ids (as one number), and the id that the pair of a rank becomes.
        self.ranks: dict[int, int] = {}
        self.becomes: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[a] * _WIDE + ids[b], rank)
            self.becomes.append(ids[a + b])
        self.any_pieces, self.ascii_pieces = regex.compile(PIECES).findall, re.compile(ASCII_PIECES, re.ASCII).findall
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special, self.cut = special, regex.compile("|".join(map(regex.escape, special)))
        self.known_parts: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        """The number of tokens of one piece."""
        first, becomes, rank_of = self.first, self.becomes, self.ranks.get
        symbols = [first[b] for b in piece.encode("utf-8")]
        n = left = len(symbols)
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a * _WIDE + b)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        symbols.append(_END)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if rank_of(symbols[i] * _WIDE + symbols[j]) != rank:
                continue  # one of the two was merged meanwhile
            merged = becomes[rank]
            symbols[i], symbols[j] = merged, _GONE
            left -= 1
            k = after[i] = after[j]
            before[k] = i
            if (r := rank_of(merged * _WIDE + symbols[k])) is not None:
                heapq.heappush(heap, r << 32 | i)
            p = before[i]
            if p >= 0 and (r := rank_of(symbols[p] * _WIDE + merged)) is not None:
                heapq.heappush(heap, r << 32 | p)
        return left

    def count(self, text: str) -> int:
        """The number of tokens of a text; a special string in it is one token, as the library has it."""
        if not any(x in text for x in self.special):
            return self.count_plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))

    def count_plain(self, text: str) -> int:
        """count() of a text in which special strings are ordinary text."""
        return sum(map(self.tokens, (self.ascii_pieces if text.isascii() else self.any_pieces)(text)))


    def counts(self, texts) -> np.ndarray:
        """count() of each text of an Arrow array of strings; null: 0.

        Where no white space stands before a space, no piece crosses a place before a
        space, so such texts are counted part by part, each distinct part of a batch once.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros(len(texts), np.int64)
        plain: list[int] = []
        for i, x in enumerate(texts):
            if x.is_valid:
                text = x.as_buffer().to_pybytes().decode("utf-8", "replace")
                if any(s in text for s in self.special) or _wide_gap(text):
                    out[i] = self.count(text)
                else:
                    plain.append(i)
        if not plain:
            return out
        split = pc.split_pattern(texts.take(pa.array(plain)).cast(pa.large_string()), " ")
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        flat = split.flatten()
        parts = flat.dictionary_encode()
        known = self.known_parts
        if len(known) > REMEMBERED:
            known.clear()
        words = parts.dictionary.to_pylist()
        for w in words:
            if w not in known:
                known[w] = self.count_plain(" " + w)
        each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[parts.indices.to_numpy()]
        for at in offsets[:-1].tolist():  # the first part of a text has no space before it
            each[at] = self.count_plain(flat[at].as_py())
        out[plain] = np.add.reduceat(each, offsets[:-1])
        return out


_GAPS = tuple(c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_GAP = re.compile(r"\s ")


def _wide_gap(text: str) -> bool:
    """Whether white space stands before a space."""
    return any(g in text for g in _GAPS) if text.isascii() else _GAP.search(text) is not None


_loaded: dict[str, Merges] = {}


def loaded(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def count_column(text: Column, path: str) -> Column:
    """The number of tokens of a text column; null and empty texts: 0. path: a vocabulary file that each worker can read."""

    @arrow_udf("long")
    def token_count(texts):
        import pyarrow as pa

        merges = loaded(path)
        return pa.array(np.concatenate([merges.counts(texts[i : i + 2048]) for i in range(0, len(texts), 2048)] or [np.zeros(0, np.int64)]))

    return token_count(text)


def counted(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of columns of those names.

    Null and empty texts have 0 of each. Texts are taken whole. Rows stay, repeated ones too.
    """
    text = F.col(text_col)
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": count_column(text, path),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
