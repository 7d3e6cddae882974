"""MIME trees of raw messages as rows: bodies, attachments and headers in one Arrow pass.

The parts of a message are listed parents first. One pass over the list then hands
each part's standing down to its children: below a multipart/alternative only the
chosen child may give text, below multipart/related only the root, below
multipart/mixed only the first part that can be a body; what else stands there is an
attachment. Rows are built per message, so memory is bounded by the largest one.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from datetime import datetime
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.sources.mail import POLICY, canonical_id

BATCH_BYTES = 8 << 20
BODY_TYPES = {"text/plain": "plain", "text/html": "html", "text/markdown": "markdown"}
RAW_SCHEMA = (
    "mail_id string, part_index int, parent_index int, role string, inline boolean, content_type string, disposition string, filename string, "
    "content_id string, body_format string, text string, content binary, message_id string, in_reply_to string, references string, subject string, "
    "senders array<string>, recipients array<string>, sent_at string, error string")
NAMES = [c.split()[0] for c in RAW_SCHEMA.split(", ")]


def id_list(header: Column) -> Column:
    """Canonical identifiers of a header: those in angle brackets, else words; malformed ones are left out."""
    bare = header
    for _ in range(3):
        # Comments nest; each step removes the innermost ones.
        bare = F.regexp_replace(bare, r"\([^()]*\)", "")
    marked = F.regexp_extract_all(bare, F.lit("<[^<>]+>"), F.lit(0))
    words = F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " ")
    found = F.filter(F.transform(F.when(F.size(marked) > 0, marked).otherwise(words), canonical_id), lambda x: x.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def _only(header: Column) -> Column:
    """The single identifier of a header; null for none or several."""
    ids = id_list(header)
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))


def _attached(part: EmailMessage) -> bool:
    return part.get_content_disposition() == "attachment" or part.get_filename() is not None


def _payload(part: EmailMessage) -> bytes:
    data = part.get_payload(decode=True)
    if part.defects or not isinstance(data, bytes):
        raise ValueError("malformed transfer encoding")
    return data


def _text(part: EmailMessage) -> str:
    charset = part.get_content_charset() or "utf-8"
    codecs.lookup(charset)
    return _payload(part).decode(charset)


def _readable(part: EmailMessage) -> bool:
    try:
        _text(part)
    except (LookupError, ValueError):
        return False
    return True


def _chosen(part: EmailMessage, children: list[EmailMessage]) -> int | None:
    """Which child gives the text of a container; None where every child may."""
    kind = part.get_content_subtype()
    if kind == "alternative":
        for wanted in ("text/plain", "text/html"):
            for i, child in enumerate(children):
                if child.get_content_type() == wanted and not _attached(child) and _readable(child):
                    return i
        raise ValueError("no readable alternative")
    if kind == "related":
        if not children:
            raise ValueError("related parts are missing")
        start = (part.get_param("start") or "").strip("<> ")
        same = [i for i, c in enumerate(children) if start and (c.get("Content-ID") or "").strip("<> ") == start]
        return same[0] if same else 0
    if kind == "mixed":
        for i, child in enumerate(children):
            nested = child.is_multipart() and child.get_content_subtype() in ("alternative", "related")
            if not _attached(child) and (nested or child.get_content_type() in BODY_TYPES):
                return i
        return -1
    return None


def _parts(message: EmailMessage, contents: bool) -> list[dict]:
    """One row per part, parents first, with the role its standing gives it."""
    rows: list[dict] = []
    stack: list[tuple[EmailMessage, int | None, str]] = [(message, None, "open")]
    while stack:
        part, parent, standing = stack.pop()
        kind, disposition = part.get_content_type(), part.get_content_disposition()
        at, children = len(rows), list(part.iter_parts()) if part.is_multipart() and part.get_content_maintype() == "multipart" else []
        row = {"part_index": at, "parent_index": parent, "content_type": kind, "disposition": disposition, "filename": part.get_filename(),
               "content_id": part.get("Content-ID"), "inline": False}
        rows.append(row)
        below = ["covered"] * len(children)
        if standing in ("covered", "unused"):
            row["role"], below = standing, [standing] * len(children)
        elif standing == "open" and children:
            row["role"], one = "container", _chosen(part, children)
            rest = {"alternative": "unused", "related": "inline"}.get(part.get_content_subtype(), "attached")
            below = ["open" if i == one else rest for i in range(len(children))] if one is not None else [
                "attached" if _attached(c) else "open" for c in children]
        elif standing == "open" and kind.startswith("text/") and (parent is None or not _attached(part)):
            row.update(role="body", text=_text(part), body_format=BODY_TYPES.get(kind, "plain"))
        else:
            row.update(role="attachment", inline=standing == "inline" or disposition == "inline")
            if not children and (contents or (row["inline"] and kind.startswith("image/"))) and not part.is_multipart():
                row["content"] = _payload(part)
        stack.extend((c, at, s) for c, s in reversed(list(zip(children, below))))
    return rows


def _addresses(message: EmailMessage, *names: str) -> list[str]:
    return [a for _, a in getaddresses([str(v) for n in names for v in message.get_all(n, [])]) if a]


def _sent(message: EmailMessage) -> str | None:
    try:
        stamp = parsedate_to_datetime(str(message.get("Date")))
    except (TypeError, ValueError, IndexError):
        return None
    return stamp.isoformat(timespec="seconds") if isinstance(stamp, datetime) and stamp.tzinfo else None


def _rows(mail_id: str, raw: bytes | str | None, contents: bool) -> list[dict]:
    try:
        data = raw.encode() if isinstance(raw, str) else bytes(raw)
        message = BytesParser(policy=POLICY).parsebytes(data)
        if any(p.defects for p in message.walk()):
            raise ValueError("malformed structure")
        rows = _parts(message, contents)
        subject = " ".join(str(message.get("Subject") or "").split())
        rows[0].update(
            message_id=message.get("Message-ID"), in_reply_to=message.get("In-Reply-To"), references=message.get("References"), subject=subject or None,
            senders=_addresses(message, "From"), recipients=_addresses(message, "To", "Cc", "Bcc"), sent_at=_sent(message))
    except Exception as error:  # noqa: BLE001 - a bad message is a row, not a failed job
        rows = [{"part_index": 0, "role": "broken", "inline": False, "error": f"{type(error).__name__}: {error}"}]
    # Header values are objects of the parser; rows hold plain strings.
    return [{"mail_id": mail_id, **{k: str(v) if isinstance(v, str) else v for k, v in r.items()}} for r in rows]


def _frame(rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame([[r.get(n) for n in NAMES] for r in rows], columns=NAMES, dtype=object)
    return made.astype({"part_index": "Int32", "parent_index": "Int32"})


def mime_parts(mails: DataFrame, contents: bool = False) -> DataFrame:
    """Every part of raw messages (mail_id, raw as bytes or text), parents first.

    ``role``: container, body (``text``, ``body_format``), attachment, unused (an
    alternative not chosen), covered (inside an attachment) or broken. A message that
    cannot be read gives one broken row with its ``error``; a null one too. Headers
    stand in the row of part 0, identifiers canonical. ``content`` holds the bytes of
    inline images, with ``contents`` of all attachments.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for mail_id, raw in zip(batch["mail_id"], batch["raw"]):
                rows += _rows(mail_id, raw, contents)
                size += len(raw) if raw is not None else 0
                if size > BATCH_BYTES:
                    yield _frame(rows)
                    rows, size = [], 0
            if rows:
                yield _frame(rows)

    parts = mails.select("mail_id", "raw").mapInPandas(parse, RAW_SCHEMA)
    return parts.withColumns({
        "message_id": _only(F.col("message_id")), "in_reply_to": _only(F.col("in_reply_to")), "content_id": _only(F.col("content_id")),
        "references": F.when(F.col("part_index") == 0, id_list(F.col("references")))})


def messages(parts: DataFrame) -> DataFrame:
    """Headers of readable messages, with ``refs`` as thread building expects them; stored, as it reads them several times."""
    return cut(parts.filter("part_index = 0 and error is null").select(
        "mail_id", "message_id", "in_reply_to", F.col("references").alias("refs"), "subject", "senders", "recipients", "sent_at"))


def bodies(parts: DataFrame) -> DataFrame:
    """Text of messages by part, without blank ones."""
    return parts.filter("role = 'body' and trim(regexp_replace(text, '[\\\\s]+', ' ')) <> ''").select(
        "mail_id", "part_index", "body_format", "text")


def attachments(parts: DataFrame) -> DataFrame:
    """One row per attachment; ``content`` as kept by ``mime_parts``, with its hash."""
    return parts.filter("role = 'attachment'").select(
        "mail_id", "part_index", "content_type", "disposition", "filename", "content_id", "inline", "content", F.sha2("content", 256).alias("content_hash"))
