"""Mailboxes: splitting, identifiers and MIME bodies."""

from __future__ import annotations

from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X

# Fixed value: shape of a message identifier.
BARE_ID = r"^[^\s<>@]+@[^\s<>@]+$"
MESSAGE_SCHEMA = (
    "mail_id string, message_id string, in_reply_to string, subject string, sender string, sent_at string, "
    "body string, body_format string, attachments int, error string")

#: Headers up to this length are remembered, so many at a time.
REMEMBERED, HEADERS = 1024, 4096


@lru_cache(maxsize=HEADERS)
def _header(name: str, value: str) -> str:
    return policy.default.header_fetch_parse(name, value)


class _Remembering(policy.EmailPolicy):
    """The default policy reads a header anew at each look; here one that stands in many parts is read once."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        known = not hasattr(value, "name") and len(value) <= REMEMBERED
        return _header(name, value) if known else super().header_fetch_parse(name, value)


POLICY = _Remembering()


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailbox files: the separator line is the record delimiter, so a
    mailbox of any size is split across tasks by the reader."""
    raw = spark.read.option("lineSep", "\nFrom ").text(path).select(
        F.input_file_name().alias("path"), F.regexp_replace("value", r"^(?:From )?[^\n]*\n?", "").alias("message"))
    return raw.withColumn("message", unescape("message")).filter(X.strip(F.col("message")) != "")


def unescape(column: str) -> Column:
    return F.regexp_replace(column, r"(?m)^>From ", "From ")


def split_mbox(boxes: DataFrame) -> DataFrame:
    """Messages of mailboxes held as text (box_id, text); the first line is a separator."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\nFrom [^\n]*(?=\n|$)")
    rows = X.unfold(boxes, ["box_id"], parts, "message", "part").filter("part > 0")
    whole = F.regexp_replace(unescape("message"), r"^\n", "")
    return rows.select("box_id", "part", whole.alias("message")).filter(X.strip(F.col("message")) != "")


def canonical_id(value: Column) -> Column:
    """Identifier without comments and spaces, domain in lower case; null if malformed."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\([^()]*\)", ""), r"[ \t\r\n]+", "")
    compact = F.regexp_replace(bare, r"^[<>]+|[<>]+$", "")
    at = F.regexp_extract(compact, r"^(.*)@([^@]*)$", 1)
    domain = F.regexp_extract(compact, r"^(.*)@([^@]*)$", 2)
    return F.when(F.rlike(compact, F.lit(BARE_ID)), F.concat(at, F.lit("@"), F.lower(domain)))


def _body(message) -> tuple[str, str]:
    part = message.get_body(preferencelist=("plain", "html"))
    if part is None:
        return "", "none"
    return part.get_content(), "html" if part.get_content_subtype() == "html" else "plain"


def decode_messages(mails: DataFrame) -> DataFrame:
    """Headers and chosen body of raw messages (mail_id, raw); failures are rows."""
    columns = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]

    def one(mail_id: str, raw: str) -> list:
        try:
            message = BytesParser(policy=POLICY).parsebytes(raw.encode("utf-8"))
            sender = getaddresses([str(v) for v in message.get_all("From", [])])
            sent = message.get("Date")
            stamp = parsedate_to_datetime(str(sent)).isoformat(timespec="seconds") if sent else None
            body, kind = _body(message)
            return [mail_id, message.get("Message-ID"), message.get("In-Reply-To"), message.get("Subject"),
                    sender[0][1] if sender else None, stamp, body, kind, sum(1 for _ in message.iter_attachments()), None]
        except Exception as error:  # noqa: BLE001 - a bad message must not fail the batch
            return [mail_id, None, None, None, None, None, None, None, 0, type(error).__name__]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [one(i, r) for i, r in zip(batch["mail_id"], batch["raw"])]
            yield pd.DataFrame(out, columns=columns).astype({"attachments": "int32"})

    decoded = mails.select("mail_id", "raw").mapInPandas(decode, MESSAGE_SCHEMA)
    return decoded.withColumn("message_id", canonical_id(F.col("message_id"))).withColumn(
        "in_reply_to", canonical_id(F.col("in_reply_to")))
