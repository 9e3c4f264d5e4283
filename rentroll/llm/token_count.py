"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into the tokenizer's pre-tokens. In each, the adjacent pair of lowest rank is merged again and
again; a heap holds the pairs and a doubly linked list the symbols. The count is the number of initial symbols
less the number of merges: no token identifier is ever looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1 << 20  # pre-tokens whose count a worker keeps before it starts over, and half as many chunks
#: A blank beside other white space may belong to its pre-token; every other blank begins one.
_BLANKS = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
                            0x2029, 0x202F, 0x205F, 0x3000)]
_LOOSE = [pair for b in _BLANKS for pair in {f" {b}", f"{b} "}]
_LOOSE_ASCII = [pair for pair in _LOOSE if pair.isascii()]
_loaded: dict[str, "Counter"] = {}


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Counter(dict):
    """Pre-token -> number of tokens, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PRE_TOKEN).findall
        self.chunks: dict[str, int] = {}

    def __missing__(self, pre_token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[pre_token] = n = self.merged(pre_token.encode("utf-8"))
        return n

    def merged(self, raw: bytes) -> int:
        """Symbols left of ``raw`` when no pair has a rank any more."""
        symbols: list[str | None] = [self.letters[b] for b in raw]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return n - merges

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it is one token, as the library takes it by default."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if any(pair in text for pair in (_LOOSE_ASCII if text.isascii() else _LOOSE)) or text[:1] == " " or text[-1:] == " ":
            return sum(map(self.__getitem__, self.split(text)))
        first, *others = text.split(" ")
        found = list(map(self.chunks.get, others))
        if None in found:
            found = [self._chunk(c) if n is None else n for c, n in zip(others, found, strict=True)]
        return sum(found) + sum(map(self.__getitem__, self.split(first)))

    def _chunk(self, chunk: str) -> int:
        """Tokens of a chunk with the blank before it; no pre-token reaches over its ends."""
        if len(self.chunks) >= REMEMBERED // 2:
            self.chunks.clear()
        self.chunks[chunk] = n = sum(map(self.__getitem__, self.split(" " + chunk)))
        return n


def counter(path: str) -> Counter:
    """One per worker and file, so that tasks share what has been merged."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens. A NULL or empty text has none of either; nothing is cut.

    ``vocabulary``: path of a byte-level BPE file, the same on every executor. Repeated rows stay; other columns
    are not read. No shuffle; a worker keeps the counts of ``REMEMBERED`` pre-tokens at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            tokens, sizes = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                tokens.append(count(text))
                sizes.append(len(text.encode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    keyed = rows.select(rows[id_col].cast("long").alias("id"), rows[text_col].cast("string").alias("text"))
    return keyed.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
