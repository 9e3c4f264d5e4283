"""Message tables: search, recent messages, bodies and attachments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.functions.markup import html_to_text
from rentroll.functions.text import contains_any
from rentroll.operators.sequence import running_total
from rentroll.session import durable


@dataclass(frozen=True)
class SearchCriteria:
    """All given criteria must hold; blank or absent ones are ignored."""

    sender: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    subject: str | None = None
    body: str | None = None
    unread_only: bool = False

    def predicate(self) -> Column:
        conds = []
        for column, wanted in (("from", self.sender), ("subject", self.subject), ("body", self.body)):
            if wanted:
                conds.append(contains_any(F.col(f"`{column}`"), [wanted]))
        if self.start:
            conds.append(received_from(self.start))
        if self.end:
            conds.append(received_through(self.end))
        if self.unread_only:
            conds.append(unread())
        return reduce(lambda a, b: a & b, conds, F.lit(True))


def _moment(day: dt.date) -> Column:
    # a text literal takes the column's own timestamp type, so the bound reaches the scan
    return F.lit(f"{day.isoformat()} 00:00:00")


def received_from(day: dt.date) -> Column:
    return F.col("received_date") >= _moment(day)


def received_through(day: dt.date) -> Column:
    """Up to the end of ``day``."""
    return F.col("received_date") < _moment(day + dt.timedelta(days=1))


def unread() -> Column:
    return ~F.coalesce(F.col("read"), F.lit(False))


def search(messages: DataFrame, criteria: SearchCriteria) -> DataFrame:
    return messages.filter(criteria.predicate())


def in_range(messages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Messages received from ``start`` to ``end``, both days included."""
    return messages.filter(received_from(start) & received_through(end))


def unread_in_range(messages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return in_range(messages, start, end).filter(unread())


def trailing_days(messages: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Messages of the days before ``as_of``, that day included."""
    return in_range(messages, as_of - dt.timedelta(days=days), as_of)


def most_recent(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest message numbers, in ascending order."""
    return messages.orderBy(F.desc("message_number")).limit(max(n, 0)).orderBy("message_number")


def bill_notices(messages: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Messages whose subject holds any of the phrases."""
    return messages.filter(contains_any(F.col("subject"), phrases))


def first_sender(addresses: Column) -> Column:
    return F.get(addresses, F.lit(0))


def part_text(mime_type: Column, content: Column) -> Column:
    """Plain text as it is, HTML as its visible words, nothing for other parts."""
    kind = F.lower(mime_type)
    return (
        F.when(kind.startswith("text/plain"), content)
        .when(kind.startswith("text/html"), html_to_text(content))
        .otherwise(F.lit(""))
    )


def message_bodies(parts: DataFrame, parts_per_row: int = 1000) -> DataFrame:
    """(message_number, segment, body): part texts joined in part order, nothing between them.

    ``parts`` holds message_number, part_no (from 0), mime_type and content. A
    message of up to ``parts_per_row`` parts is one row, segment 0; a longer one
    goes on over further rows, so no task gathers an unbounded message.
    """
    texts = parts.select(
        "message_number", "part_no", part_text(F.col("mime_type"), F.col("content")).alias("text"),
        F.floor(F.col("part_no") / parts_per_row).cast("int").alias("segment"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "text")))
    return texts.groupBy("message_number", "segment").agg(
        F.array_join(ordered.getField("text"), "").alias("body")
    )


def body_pieces(parts: DataFrame, chars_per_row: int, *more: str) -> DataFrame:
    """(message_number, segment, part_no, piece, *more): part texts cut where a message's pages of characters end.

    A part of no text is one empty piece of the page that the text before it ends in. Stores the texts.
    """
    text = F.coalesce(part_text(F.col("mime_type"), F.col("content")), F.lit(""))
    texts = parts.select("message_number", "part_no", *more, text.alias("text")).withColumn("chars", F.char_length("text").cast("long"))
    at = running_total(durable(texts, "part-texts"), "part_no", "chars", ["message_number"])
    size = F.lit(chars_per_row).cast("long")

    def page(place: Column) -> Column:
        return F.floor(F.greatest(place, F.lit(0)) / size)

    def piece(segment: Column) -> Column:
        start = F.greatest(segment * size - F.col("before"), F.lit(0))
        end = F.least((segment + 1) * size - F.col("before"), F.col("chars"))
        cut = F.substr("text", (start + 1).cast("int"), (end - start).cast("int"))
        return F.struct(segment.cast("int").alias("segment"), F.when(F.col("chars") > 0, cut).otherwise(F.lit("")).alias("piece"))

    last = page(F.col("before") + F.col("chars") - 1)
    pages = F.when(F.col("chars") > 0, F.sequence(page(F.col("before")), last)).otherwise(F.array(last))
    cut = at.select("message_number", "part_no", *more, F.explode(F.transform(pages, piece)).alias("_cut"))
    return cut.select("message_number", "_cut.segment", "part_no", "_cut.piece", *more)


def _joined() -> Column:
    """Aggregate: the pieces in part order; empty ones are not gathered."""
    found = F.collect_list(F.when(F.col("piece") != "", F.struct("part_no", "piece")))
    return F.array_join(F.sort_array(found).getField("piece"), "")


def bounded_bodies(parts: DataFrame, chars_per_row: int = 100_000) -> DataFrame:
    """(message_number, segment, body): as message_bodies, in pages of ``chars_per_row`` characters.

    Every page but a message's last has exactly that many (at most four bytes each), whatever the sizes of its parts, and
    a part may go on over several pages. A message without any text has one empty page.
    """
    return body_pieces(parts, chars_per_row).groupBy("message_number", "segment").agg(_joined().alias("body"))


def notice_details(messages: DataFrame, parts: DataFrame, recipients: DataFrame, phrases: Sequence[str],
                   chars_per_row: int = 100_000, names_per_row: int = 1000) -> DataFrame:
    """Bill notices whole: (message_number, segment, subject, from, received_date, body, attachments, recipients).

    A notice is one row, or more where its text has over ``chars_per_row`` characters or its parts or recipients number
    over ``names_per_row``: segment 0 has subject, sender and date, and every segment its page of each. attachments are
    the file names of attached parts of multipart messages: empty where there are none, NULL for other messages.
    recipients are the addresses of kind To in order; NULL where there are none. A body is empty where a message has no text.
    ``messages`` holds one row for each number, ``recipients`` message_number, place (from 0), kind and address; other
    columns are not read. Parts and recipients of other messages go before anything moves; what is left is gathered
    in one aggregation of tagged rows.
    """
    notices = bill_notices(messages, phrases).select("message_number", "subject", "from", "received_date")
    notices = durable(notices, "notices")  # of known size, so that a short list may be sent to the parts
    numbers = notices.select("message_number")
    parts = parts.join(numbers, "message_number", "left_semi")
    pieces = body_pieces(parts, chars_per_row, "multipart")
    attached = (F.lower(F.trim("disposition")) == "attachment") & F.col("multipart")
    files = parts.filter(attached).select(
        "message_number", F.floor(F.col("part_no") / names_per_row).cast("int").alias("segment"), F.lit(True).alias("multipart"),
        F.struct("part_no", "file_name").alias("file"))
    to = recipients.join(numbers, "message_number", "left_semi").filter(F.lower(F.trim("kind")) == "to").select(
        "message_number", F.floor(F.col("place") / names_per_row).cast("int").alias("segment"), F.struct("place", "address").alias("recipient"))
    heads = notices.withColumn("segment", F.lit(0))
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [heads, pieces, files, to])

    def listed(column: str, field: str) -> Column:
        return F.sort_array(F.collect_list(column)).getField(field)

    gathered = tagged.groupBy("message_number", "segment").agg(
        *(F.max(c).alias(c) for c in ("subject", "from", "received_date")), _joined().alias("body"),
        F.max("multipart").alias("_multipart"), listed("file", "file_name").alias("_files"), listed("recipient", "address").alias("_to"))
    return gathered.select(
        "message_number", "segment", "subject", "from", "received_date", "body", F.when(F.col("_multipart"), F.col("_files")).alias("attachments"),
        F.when(F.size("_to") > 0, F.col("_to")).alias("recipients"))


def attachments(parts: DataFrame, parts_per_row: int = 1000) -> DataFrame:
    """(message_number, segment, attachments): file names of attached parts in part order.

    Empty for a multipart message without attachments; NULL for a message of one
    part. ``parts`` holds message_number, part_no, disposition, file_name and multipart.
    """
    attached = F.lower(F.trim("disposition")) == "attachment"
    listed = F.sort_array(F.collect_list(F.when(attached, F.struct("part_no", "file_name"))))
    segment = F.floor(F.col("part_no") / parts_per_row).cast("int").alias("segment")
    return (
        parts.groupBy("message_number", segment)
        .agg(F.max("multipart").alias("_multipart"), listed.alias("_files"))
        .select(
            "message_number", "segment",
            F.when(F.col("_multipart"), F.col("_files").getField("file_name")).alias("attachments"),
        )
    )
