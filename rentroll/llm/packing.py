"""Cost-balanced packing of token ids into sequences of fixed capacity.

A document's whole runs of ``capacity`` tokens are sequences of their own. The remainders of a bucket of
documents go, in descending order, each to the sequence of lowest attention cost that has room for it, the cost
of n tokens in one document being n + n^2 / QUADRATIC. A bucket gets as many sequences as its tokens need; a
remainder that fits in none is cut to fill the one with most room, and its rest goes on in turn.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
QUADRATIC = 4096.0  # tokens at which the quadratic part of the cost equals the linear part
END_ID = 1
BUCKET_DOCUMENTS = 2048  # documents packed together, so at most that many remainders meet in a task
KEPT_BYTES, KEPT_LENGTH, ENTRY_BYTES = 256 << 20, 64, 180  # a worker's store; the longest piece in it; an entry's own bytes
SLICE_BYTES = 4 << 20
#: The tokenizer's pre-token pattern, its letters, numbers and white space written out for Latin-1.
LATIN = re.compile(r"[\x00-\xff]*")
PRE_TOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: The same in Arrow: signs and digits to be set apart, and what makes a chunk odd.
SIGNS = r"([^\t-\r \x{85}\x{a0}a-zªµºß-öø-ÿ0-9²³¹¼½¾]+|[0-9²³¹¼½¾])"
ODD = r"[^\x00-\x{ff}]|'|<\|"

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")
_tokenizers: dict[tuple[str, int | None], "WordIds"] = {}


def gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat``, each ending where ``ends`` says, put together in the order of ``at``; and where those end."""
    size = np.diff(ends, prepend=0)
    n, start = size[at], (ends - size)[at]
    out = np.cumsum(n)
    return flat[np.repeat(start - out + n, n) + np.arange(out[-1] if len(out) else 0)], out


class WordIds:
    """Ids of texts as two-byte numbers.

    This kind of tokenizer drops white space, which bounds its pre-tokens, so a chunk between blanks has the same ids
    alone. Texts are cut into chunks and those told apart in Arrow, and the distinct ones are cut into words there:
    letters, single digits and runs of other signs. Chunks that need more care (an apostrophe, a special token's
    string, letters beyond Latin-1) are looked at one by one. Words that are new go to the tokenizer in one call,
    divided by a special token, and are remembered unless they are long; the store starts over when it holds
    ``store_bytes``.
    """

    def __init__(self, path: str, store_bytes: int | None = None):
        self.store_bytes = KEPT_BYTES if store_bytes is None else store_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than two bytes")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[-1]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; none of them holds a special token."""
        if not pieces:
            return []
        joined = self.tokenizer.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids
        ids = np.array(joined, "<u2")
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
        data, out, low = ids.tobytes(), [], 0
        for end in ends:
            out.append(data[2 * low : 2 * end])
            low = end + 1
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        got = list(map(self.known.get, words))
        if None not in got:
            return got
        new = list({w for w, ids in zip(words, got, strict=True) if ids is None})
        fresh = dict(zip(new, self._encoded(new), strict=True))
        if self.held > self.store_bytes:
            self.known.clear()
            self.held = 0
        for word, ids in fresh.items():
            if len(word) <= KEPT_LENGTH:
                self.known[word] = ids
                self.held += ENTRY_BYTES + len(word) + len(ids)
        return [fresh[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]

    def _odd(self, chunk: str) -> bytes:
        if "<|" in chunk:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(self._words(PRE_TOKENS.findall(chunk.lower()) if LATIN.fullmatch(chunk) else [chunk]))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and where each chunk's end."""
        odd = pc.match_substring_regex(chunks, ODD).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(pa.array(~odd))), SIGNS, r" \1 "), " ")
        told = cut.flatten().dictionary_encode()
        got = self._words(told.dictionary.to_pylist())
        flat, ends = gathered(np.frombuffer(b"".join(got), "<u2"), np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) // 2,
                              told.indices.to_numpy())
        bounds = np.asarray(cut.offsets)
        ends = np.append(0, ends)[bounds[1:] - bounds[0]]
        rest = [self._odd(c) for c in chunks.filter(pa.array(odd)).to_pylist()]
        if not rest:
            return flat, ends
        ends = np.append(ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(r) // 2 for r in rest]))
        order = np.empty(len(odd), np.int64)
        order[~odd], order[odd] = np.arange(len(odd) - len(rest)), np.arange(len(odd) - len(rest), len(odd))
        return gathered(np.append(flat, np.frombuffer(b"".join(rest), "<u2")), ends, order)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end; a NULL text is empty."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        told = parts.flatten().dictionary_encode()
        ids, ends = gathered(*self._chunks(told.dictionary), told.indices.to_numpy())
        bounds = np.asarray(parts.offsets)
        return ids, np.append(0, ends)[bounds[1:] - bounds[0]]


def tokenizer(path: str, store_bytes: int | None = None) -> WordIds:
    if (path, store_bytes) not in _tokenizers:
        _tokenizers[path, store_bytes] = WordIds(path, store_bytes)
    return _tokenizers[path, store_bytes]


def encoded(words: WordIds, texts: pa.Array, slice_bytes: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each text; texts are taken some ``slice_bytes`` (``SLICE_BYTES``) at a time."""
    slice_bytes = SLICE_BYTES if slice_bytes is None else slice_bytes
    texts = texts.cast(pa.string())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        most = (sizes[low - 1] if low else 0) + slice_bytes
        high = max(low + 1, int(np.searchsorted(sizes, most, "right")))
        ids, ends = words.ids(texts.slice(low, high - low))
        yield from np.split(ids, ends[:-1])
        low = high


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def pack(remainders: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, tokens) as (item, from, tokens, sequence, offset) pieces; sequences are numbered from 0.

    Ties in length go by item. No sequence is over ``capacity``, and all but the free room of one sequence of the
    bucket is used.
    """
    need = -(-sum(n for _, n in remainders) // capacity)
    room, costs = np.full(need, capacity), np.zeros(need)
    queue = [(-n, item, 0) for item, n in remainders if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, item, begin = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if fits.any():
            s = int(np.where(fits, costs, np.inf).argmin())
            put = n
        else:
            s = int(room.argmax())
            put = int(room[s])
            heapq.heappush(queue, (put - n, item, begin + put))
        out.append((item, begin, put, s, int(capacity - room[s])))
        room[s] -= put
        costs[s] += cost(put)
    return out


def pack_documents(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, store_bytes: int | None = None, slice_bytes: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that hold every id once.

    A document's ids are the tokenizer's without special ones added, then ``END_ID``; so a NULL or empty text is
    one id. Repeated rows are packed as documents of their own. No rows give no pieces. Buckets are drawn by a
    hash of id and text length and hold about ``BUCKET_DOCUMENTS`` documents whatever the size of the table; copies
    of one row under one id share a bucket only by salting on the row's place, so no key is hot. ``store_bytes``
    bounds the words that a worker remembers, ``slice_bytes`` the text that it works on at once.
    """
    keyed = rows.select(rows[id_col].cast("long").alias("doc_id"), rows[text_col].cast("string").alias("text"))
    buckets = max(1, -(-keyed.count() // BUCKET_DOCUMENTS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary, store_bytes)
        for batch in batches:
            out: list[tuple] = []
            for i, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), encoded(words, batch.column(1), slice_bytes), strict=True)):
                ids = np.append(ids, np.uint16(END_ID))
                bucket = zlib.crc32(f"{doc} {len(ids)} {i}".encode()) % buckets
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((bucket, doc, start, capacity, crc(ids[start : start + capacity]), len(ids), None))
                if whole < len(ids):
                    out.append((bucket, doc, whole, len(ids) - whole, None, len(ids), ids[whole:].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["bucket", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    def fill(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        got = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")]).to_pylist()
        out = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["length"]) for r in got if r["ids"] is None]
        placed = [(*piece[:5], sequence, 0) for sequence, piece in enumerate(out)]
        full = len(placed)
        rest = [r for r in got if r["ids"] is not None]
        for item, begin, n, sequence, offset in pack([(i, r["length"]) for i, r in enumerate(rest)], capacity):
            r = rest[item]
            ids = np.frombuffer(r["ids"], "<u2")[begin : begin + n]
            placed.append((r["doc_id"], r["start"] + begin, n, crc(ids), r["doc_tokens"], full + sequence, offset))
        columns = [list(c) for c in zip(*placed, strict=True)]
        columns[5] = [(bucket << 32) + s for s in columns[5]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    cut = keyed.mapInArrow(pieces, "bucket bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                   "doc_tokens bigint, ids binary")
    return cut.groupBy("bucket").applyInArrow(fill, PIECES).select(F.col("doc_id").alias(id_col), "start", "length",
                                                                   "ids_crc32", "doc_tokens", "sequence_id", "offset")
