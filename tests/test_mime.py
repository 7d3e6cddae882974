"""MIME trees: roles of parts, headers, broken messages."""

from corpusloom.sources import mime

HEAD = "From: A <a@x.org>\nMessage-ID: <m1@X.org>\nMIME-Version: 1.0\n"


def roles(raw, contents=False):
    return [(r["part_index"], r.get("parent_index"), r["role"], r["inline"]) for r in mime._rows("m", raw, contents)]


def multi(kind, *parts, extra="", mark="b"):
    return f'Content-Type: multipart/{kind}; boundary="{mark}"{extra}\n\n' + "".join(f"--{mark}\n{p}\n" for p in parts) + f"--{mark}--\n"


PLAIN, HTML = "Content-Type: text/plain\n\nplain", "Content-Type: text/html\n\n<p>h</p>"
FILE = 'Content-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\nContent-Transfer-Encoding: base64\n\nQUJD'
BAD = "Content-Type: text/plain; charset=no-such-charset\n\nx"


def test_alternative_takes_plain_then_html_then_fails():
    assert [r[2] for r in roles(HEAD + multi("alternative", HTML, PLAIN))] == ["container", "unused", "body"]
    assert [r[2] for r in roles(HEAD + multi("alternative", BAD, HTML))] == ["container", "unused", "body"]
    assert [r[2] for r in roles(HEAD + multi("alternative", FILE))] == ["broken"]


def test_mixed_has_one_body_and_nested_parts_stand_under_their_parent():
    raw = HEAD + multi("mixed", FILE, multi("alternative", HTML, PLAIN, mark="a"), PLAIN)
    assert roles(raw) == [
        (0, None, "container", False), (1, 0, "attachment", False), (2, 0, "container", False), (3, 2, "unused", False), (4, 2, "body", False),
        (5, 0, "attachment", False)]
    assert [r[2] for r in roles(HEAD + multi("mixed", FILE, FILE))] == ["container", "attachment", "attachment"]


def test_related_root_by_start_and_other_containers_take_every_text():
    raw = HEAD + multi("related", FILE, "Content-ID: <r@x>\n" + HTML, extra='; start="<r@x>"')
    assert [(r[2], r[3]) for r in roles(raw)] == [("container", False), ("attachment", True), ("body", False)]
    assert [r[2] for r in roles(HEAD + multi("digest-like", PLAIN, FILE, HTML))] == ["container", "body", "attachment", "body"]


def test_a_message_inside_a_message_is_one_attachment():
    inner = "Content-Type: message/rfc822\n\n" + HEAD + multi("mixed", PLAIN, mark="i")
    assert [r[2] for r in roles(HEAD + multi("mixed", PLAIN, inner))] == ["container", "body", "attachment"]
    covered = 'Content-Disposition: attachment; filename="all"\n' + multi("mixed", PLAIN, FILE, mark="i")
    assert [r[2] for r in roles(HEAD + multi("mixed", PLAIN, covered))] == ["container", "body", "attachment", "covered", "covered"]


def test_rows_headers_nulls_and_broken_messages(spark):
    refs = "In-Reply-To: <p@X.Org> (a (nested) comment)\nReferences: <a@X.org>\n <b@x.ORG> <bad> <c@x>\nSubject:  two\n  words \nDate: Mon, 01 Jan 2024 10:00:00 -0000\n"
    long = HEAD.replace("m1", "m2") + "Content-Type: text/plain\n\n" + "word " * 200_000
    mails = [
        ("full", (HEAD + refs + multi("mixed", PLAIN, FILE)).encode()), ("latin", (HEAD + "Content-Type: text/plain; charset=latin-1\n\n").encode() + b"caf\xe9"),
        ("utf8", (HEAD + "Content-Type: text/plain; charset=utf-8\n\n").encode() + b"\xff"), ("open", (HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n' + PLAIN).encode()),
        ("null", None), ("empty", b""), ("two", (HEAD + "In-Reply-To: <a@x> <b@x>\n\nhi").encode()), ("long", long.encode()), ("long", long.encode())]
    parts = mime.mime_parts(spark.createDataFrame(mails, "mail_id string, raw binary"), contents=True).cache()
    heads = {r.mail_id: r for r in mime.messages(parts).collect()}
    full = heads["full"]
    assert (full.message_id, full.in_reply_to, full.refs, full.subject) == ("m1@x.org", "p@x.org", ["a@x.org", "b@x.org", "c@x"], "two words")
    assert full.sent_at is None and full.senders == ["a@x.org"] and heads["two"].in_reply_to is None and heads["two"].refs == []
    texts = [(r.mail_id, len(r.text)) for r in mime.bodies(parts).collect()]
    assert sorted(texts) == [("full", 5), ("latin", 4), ("long", 1_000_000), ("long", 1_000_000), ("two", 2)]
    files = mime.attachments(parts).collect()
    assert [(r.mail_id, r.filename, bytes(r.content)) for r in files] == [("full", "f.pdf", b"ABC")]
    assert {r.mail_id for r in parts.filter("role = 'broken'").collect()} == {"utf8", "open", "null"}
    assert mime.mime_parts(spark.createDataFrame([], "mail_id string, raw string")).count() == 0


def test_headers_are_read_once_and_messages_parsed_once(spark, monkeypatch):
    """A header that is looked at again, or stands in other messages, is not parsed again; threads read stored headers."""
    from email.headerregistry import HeaderRegistry

    from corpusloom.operators import threads
    from corpusloom.sources import mail

    raw = 'Message-ID: <a{}@x.org>\nIn-Reply-To: <a0@x.org>\nContent-Type: multipart/mixed; boundary="b"\n\n--b\n\nhello\n--b\nContent-Type: text/csv\n\n1,2\n--b--\n'
    seen, plain = [], HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: seen.append((name, value)) or plain(self, name, value))
    mail._header.cache_clear()
    rows = [mime._rows(str(i), raw.format(i), False) for i in range(5)]
    assert [len(r) for r in rows] == [3] * 5 and rows[4][0]["message_id"] == "<a4@x.org>"
    assert 0 < len(seen) == len(set(seen))
    mails = spark.createDataFrame([(str(i), raw.format(i)) for i in range(4)], "mail_id string, raw string")
    parents = threads.reply_parents(mime.messages(mime.mime_parts(mails)).selectExpr("*", "CAST(mail_id AS BIGINT) AS source_index"))
    assert "MapInPandas" not in parents._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in parents.collect()} == {(0, None), (1, 0), (2, 0), (3, 0)}
