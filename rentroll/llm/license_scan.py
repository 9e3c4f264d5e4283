"""Fuzzy search for short licence notices.

A notice that may hold k edits is split into k + 1 pieces: any match leaves one piece intact (pigeonhole).
Exact finds of the pieces give places; there the regex library looks for the notice within k edits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_KEPT = bytes(b for b in range(256) if b >= 0x80 or chr(b).isdigit() or chr(b).isalpha())
_TABLE = bytes((b if b in _KEPT else 0x20) for b in bytes(range(256)).lower())


@dataclass(frozen=True)
class Notice:
    """A phrase in lower-case words, its label, the edits allowed, and a word of it that must stand unchanged.

    The unchanged word tells the licence from its kin: "by nd" is one edit from "by nc" but another licence.
    """

    phrase: str
    label: str
    edits: int
    core: str

    def pieces(self) -> list[tuple[int, bytes]]:
        """(offset, piece) of k + 1 pieces of nearly equal length."""
        raw, n = self.phrase.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def patterns(self) -> list[regex.Pattern]:
        """The phrase at word ends, its core exact, one pattern for each way to deal the edits to the sides of the core;
        (?b) asks for the best match."""
        head, _, tail = f" {self.phrase} ".partition(f" {self.core} ")
        parts = [regex.escape(x.strip(), literal_spaces=True) for x in (head, tail)]
        deals = [(e, self.edits - e) for e in range(self.edits + 1)] if parts[0] and parts[1] else [(self.edits, self.edits)]
        made = []
        for deal in deals:
            fuzzy = [f"(?:{p}){{e<={e}}}" if p else "" for p, e in zip(parts, deal, strict=True)]
            made.append(regex.compile("(?b)(?<= )" + " ".join(x for x in (fuzzy[0], self.core, fuzzy[1]) if x) + "(?= )"))
        return made


NOTICES = (
    Notice("under the mit license", "mit", 2, "mit"),
    Notice("apache license version 2", "apache-2", 2, "2"),
    Notice("cc by nc", "cc-by-nc", 1, "nc"),
)

SPANS = "array<struct<label:string,first_word:bigint,n_words:bigint,edits:int,score:double>>"


class Scanner:
    """Finds notices in one text after another."""

    def __init__(self, notices: Iterable[Notice] = NOTICES):
        self.notices = [(n, n.phrase.encode(), n.pieces(), n.patterns()) for n in notices]

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """(number of words, spans in order of place); a NULL or empty text has neither."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        spans = []
        for notice, phrase, pieces, patterns in self.notices:
            exact, near = set(), {}
            for offset, piece in pieces:
                at = line.find(piece)
                while at >= 0:
                    start = at - offset
                    if start > 0 and line.startswith(b" " + phrase + b" ", start - 1):
                        exact.add(start)
                    else:
                        found = self._near(line, start, phrase, notice, patterns)
                        if found and (found[0] not in near or found[1:] < near[found[0]]):
                            near[found[0]] = found[1:]
                    at = line.find(piece, at + 1)
            hits = [(s, s + len(phrase), 0) for s in exact]
            for s, (edits, end) in sorted(near.items()):
                if not any(a < end and s < b for a, b, _ in hits):  # a find inside another is the same notice
                    hits.append((s, end, edits))
            for s, end, edits in hits:
                spans.append(
                    {"label": notice.label, "first_word": line.count(b" ", 0, s) - 1, "n_words": line.count(b" ", s, end) + 1,
                     "edits": edits, "score": max(0.0, 1.0 - edits / len(phrase))}
                )
        spans.sort(key=lambda s: (s["first_word"], s["label"]))
        return len(words), spans

    @staticmethod
    def _near(line: bytes, start: int, phrase: bytes, notice: Notice, patterns: list[regex.Pattern]) -> tuple[int, int, int] | None:
        """(start, edits, end) of the best match near ``start``, in bytes of ``line``; edits count characters."""
        reach = 4 * notice.edits  # an edit may put in a character of up to four bytes
        low = max(0, start - reach - 1)
        while low > 0 and 0x80 <= line[low] < 0xC0:
            low -= 1
        high = min(len(line), start + len(phrase) + reach + 1)
        while high < len(line) and 0x80 <= line[high] < 0xC0:
            high += 1
        part = line[low:high].decode("utf-8", "replace")
        matches = [m for m in (p.search(part) for p in patterns) if m and sum(m.fuzzy_counts) <= notice.edits]
        if not matches:
            return None
        found = min(matches, key=lambda m: (sum(m.fuzzy_counts), m.start()))
        begin = low + len(part[: found.start()].encode())
        return begin, sum(found.fuzzy_counts), begin + len(found.group().encode())


def scan_notices(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 notices: Iterable[Notice] = NOTICES) -> DataFrame:
    """One row per input row: id, n_words and every notice found as a span (first word, words, edits, score).

    Whole texts are searched. A NULL or empty text has no words and no spans; repeated rows come back repeated;
    other columns are neither read nor returned.
    """
    rules = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([s for _, s in found], pa.list_(pa.struct(
                     [("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                      ("edits", pa.int32()), ("score", pa.float64())])))],
                names=["id", "n_words", "spans"],
            )

    keyed = rows.select(rows[id_col].cast("long").alias("id"), rows[text_col].cast("string").alias("text"))
    return keyed.mapInArrow(run, f"id bigint, n_words bigint, spans {SPANS}").withColumnRenamed("id", id_col)
