"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its block elements (a token's role is the path of tags and
classes that leads to it) and its text blocks (role and text, digits masked). A token's
occurrence vector says how often it occurs on every page of its host; tokens with
equal vectors form a class. Vectors are never built: each is a sum of one random
number per page and count, which tasks add up before the shuffle, so a host with a
third of all pages is no different from others.

Three scans: (1) vectors, from which the classes of tokens on four fifths of a host's
pages or more follow (a bounded number for each host); (2) on every page, whether each class
stands in order and nested in a gap of the class around it, and how much text each
slot holds; (3) extraction: text that belongs to a valid class is template where its
element mostly holds such text; what remains are slots, of which those of the article
are joined. Elements that by tag, class, id or role are menus, headers, footers,
sidebars, notices, adverts, forms or comments are no part of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked
from corpusloom.llm import common as C

#: Pages a host needs before a text that recurs on them can be template.
PAGES = 4
#: Rows a task adds up before it passes them on.
HELD = 200_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp rb s samp small span "
    "strike strong sub sup time tt u var wbr img".split())
RAW = re.compile(r"(?i)script|style|textarea|title|xmp|iframe|noembed|noframes")
OUT = set(
    "head title script style noscript template nav footer aside form button select option textarea iframe svg canvas "
    "dialog menu object video audio map datalist".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements closed by the next of their kind, up to the element that bounds them.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SIDE = set(
    "ad ads adbox adsense adslot advert banner sponsor sponsored promo promotion nav navbar navigation navigationbar subnav topnav mainnav menu menubar "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login search form related recommended share sharing social widget toolbar "
    "pagination pager skip copyright paywall".split())
SIDE_STARTS = ("advert", "sponsor", "cookie", "sidebar", "newsletter", "breadcrumb")
TALK = re.compile(r"comments?\w*|discussion|disqus\w*|respond|repl(y|ies)|responses")
OWN = set("post entry article content story title main body".split())
LOOSE = {"form", "div", "section", "td", "tr", "table", "tbody", "ul", "li"}

OPEN = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*+)>")
CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[a-z0-9]+")
DIGITS, NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Element:
    __slots__ = ("tag", "path", "out", "talk", "main", "link", "nth")

    def __init__(self, tag: str, path: str, out: int, talk: bool, main: bool) -> None:
        self.tag, self.path, self.out, self.talk, self.main = tag, path, out, talk, main
        self.nth: Counter = Counter()


def judge(tag: str, given: dict[str, str], parent: Element) -> tuple[int, bool]:
    """(0 part of the article, 1 outside but may hold one, 2 outside; whether it holds comments or asides)."""
    out, talk = parent.out, parent.talk
    if tag in OUT:
        out = max(out, 1 if tag == "form" else 2)
        talk = talk or tag == "aside"
    elif tag == "header" and not parent.main:
        out = 2
    if "hidden" in given or given.get("aria-hidden") == "true" or HIDDEN.search(given.get("style", "")):
        out = 2
    if tag not in ("html", "body") and tag not in HEADINGS:
        names = NAMES.findall(f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower())
        if any(TALK.fullmatch(n) for n in names):
            out, talk = 2, True
        elif tag not in ("article", "main"):
            side = [n for n in names if n in SIDE or n.startswith(SIDE_STARTS)]
            if side and not (set(side) <= {"header", "banner"} and (parent.main or OWN & set(names))):
                out = max(out, 1 if tag in LOOSE else 2)
                talk = talk or len(side) == len(names) and bool({"sidebar", "aside", "related", "recommended"} & set(side))
    return out, talk


def scan(page: str) -> tuple[list[tuple[str, bool]], list[tuple]]:
    """Block elements in page order, as (path, opens), and text blocks (after how many of them, path, container, out, main, heading, text, link characters)."""
    root = Element("", "", 0, False, False)
    stack, marks, blocks = [root], [], []
    parts: list[str] = []
    linked, link_depth, plain = 0, 0, False
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = len(stack) - 1
                while at and stack[at].tag in FLOW:
                    at -= 1
                top = stack[-1]
                blocks.append((len(marks), top.path, stack[at].path, top.out > 0, top.main, top.tag in HEADINGS, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def pop(size: int) -> None:
        nonlocal in_link
        flush()
        while len(stack) > size:
            marks.append((stack.pop().path, False))
        if in_link and len(stack) < link_depth:
            in_link = False

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        following = page[lt + 1: lt + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if following == "/":
            m = CLOSE.match(page, lt)
            if not m:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            at, tag = m.end(), m[1].lower()
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = False
            elif tag not in INLINE and tag not in VOID:
                bound = SIBLINGS.get(tag, ((), ()))[1]
                k = len(stack) - 1
                while k and stack[k].tag != tag and stack[k].tag not in bound:
                    k -= 1
                if k and stack[k].tag == tag:
                    pop(k)
                else:
                    flush()
            continue
        m = None if plain else OPEN.match(page, lt)
        if m is None and following.isalpha() and following.isascii():
            plain = True  # a quote that never closes: from here on tags end at the next ">"
            m = PLAIN.match(page, lt)
        if m is None:
            say("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        if tag in INLINE or tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                if stack[-1].tag == "p":
                    pop(len(stack) - 1)
                flush()
            elif tag == "a":
                in_link, link_depth = True, len(stack)
            continue
        if RAW.fullmatch(tag):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            flush()
            continue
        given = attributes(m[2])
        if stack[-1].tag == "p":
            pop(len(stack) - 1)
        if tag in SIBLINGS:
            same, bound = SIBLINGS[tag]
            k = len(stack) - 1
            while k and stack[k].tag not in bound and stack[k].tag not in same:
                k -= 1
            if k and stack[k].tag in same:
                while k > 1 and stack[k - 1].tag in same:
                    k -= 1
                pop(k)
        elif tag in ("html", "body", "head"):
            if tag == "body":
                while len(stack) > 1 and any(e.tag == "head" for e in stack):
                    pop(len(stack) - 1)
            if any(e.tag == tag for e in stack):
                continue
        flush()
        parent = stack[-1]
        out, talk = judge(tag, given, parent)
        main = parent.main
        if tag in ("article", "main") or given.get("role") == "main":
            if out < 2 and not talk:
                out, main = 0, True
        name = tag
        if given.get("class"):
            name += "." + NUMBER.sub("0", ".".join(sorted(given["class"].split())))
        elif tag in ("div", "section", "table"):
            parent.nth[tag] += 1
            name += f"[{parent.nth[tag]}]"
        element = Element(tag, f"{parent.path}/{name}", out, talk, main)
        marks.append((element.path, True))
        stack.append(element)
        if len(stack) > 256:  # deeper nesting is flat
            pop(256)
    pop(1)
    return marks, blocks


def number(text: str) -> int:
    """A 64-bit number for a token."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def token_of(path: str, text: str) -> int:
    return number(f"{path}\0{DIGITS.sub('0', text)}")


PAGE = number("page")
CLOSES = 0x5851F42D4C957F2D
MASK = (1 << 64) - 1


def mixed(value: int) -> int:
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & MASK
    return value ^ (value >> 31)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def pages_in(part: pa.RecordBatch, column: str) -> Iterator[str]:
    for t in part.column(column).cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""


class Sums:
    """Counters by key that are passed on when there are many."""

    def __init__(self, keys: list, values: list, names: list[str]) -> None:
        self.kinds, self.names, self.values, self.held = [*keys, *values], names, len(values), {}

    def add(self, key: tuple, *values: int) -> None:
        old = self.held.get(key)
        if old is None:
            self.held[key] = list(values)
        else:
            for i, v in enumerate(values):
                old[i] += v

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.held) > least:
            columns = list(zip(*((*k, *v) for k, v in self.held.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.kinds, strict=True)], names=self.names)
            self.held = {}


LONG = pa.int64()


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan 1: sums of the occurrence vectors of tokens, in halves of 32 bits."""
    sums = Sums([pa.string(), LONG], [LONG] * 3, ["host", "token", "pages", "low", "high"])
    for part in C.slices(batches, "page"):
        for host, page in zip(part.column("host").to_pylist(), pages_in(part, "page"), strict=True):
            marks, blocks = scan(page)
            seed = number(page)
            counts = Counter(number(path) for path, opens in marks if opens)
            counts.update(token_of(b[1], b[6]) for b in blocks)
            counts[PAGE] = 1
            for token, times in counts.items():
                v = mixed(seed + times * CLOSES & MASK)
                sums.add((host, signed(token)), 1, v & 0xFFFFFFFF, v >> 32)
        yield from sums.batches(HELD)
    yield from sums.batches()


def classes(pages: DataFrame) -> DataFrame:
    """(host, tokens): tokens of classes on four fifths of a host's pages or more, as an array of (token, class).

    Their number is at most 5/4 of the mean number of distinct tokens on a page of the host.
    A class has two tokens or more; the page itself counts as one.
    """
    summed = pages.select("host", "page").mapInArrow(vectors, "host string, token long, pages long, low long, high long")
    summed = summed.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    # A text on one page alone is a slot at once; hosts of one page have no template.
    summed = C.written(summed.filter((F.col("pages") > 1) | (F.col("token") == signed(PAGE))), "vectors")
    hosts = summed.filter(F.col("token") == signed(PAGE)).select("host", F.col("pages").alias("all"))
    often = summed.join(broadcast_checked(hosts), "host").filter((F.col("pages") * 5 >= F.col("all") * 4) & (F.col("all") >= PAGES))
    low = F.col("low").bitwiseAND(F.lit(0xFFFFFFFF))
    high = (F.col("high") + F.shiftright("low", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    grouped = often.groupBy("host", F.xxhash64(low, high, "pages").alias("class")).agg(F.collect_list("token").alias("tokens"))
    member = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.col("class").alias("class")))
    return grouped.filter(F.size("tokens") > 1).groupBy("host").agg(F.flatten(F.collect_list(member)).alias("tokens"))


def nesting(sequence: list[tuple[int, int]]) -> dict[int, int]:
    """Order of each class on a page as a number, from (token, class) in page order; 0 where it is not in order or not nested."""
    order: dict[int, list[int]] = {}
    for token, group in sequence:
        order.setdefault(group, []).append(token)
    verdict, width = {}, {}
    for group, tokens in order.items():
        cycle = len(set(tokens))
        first = tokens[:cycle]
        good = len(set(first)) == cycle and len(tokens) % cycle == 0 and first * (len(tokens) // cycle) == tokens
        verdict[group] = mixed(sum(mixed(t + i * CLOSES & MASK) for i, t in enumerate(first)) & MASK) >> 1 or 1
        width[group] = cycle
        if not good:
            verdict[group] = 0
    stack: list[list[int]] = []
    for _, group in sequence:
        if not verdict[group]:
            continue
        while stack and not verdict[stack[-1][0]]:
            stack.pop()
        if stack and stack[-1][0] == group:
            stack[-1][1] += 1
        elif any(s[0] == group for s in stack):  # the class goes on while another one inside it is open
            verdict[group] = 0
            continue
        else:
            stack.append([group, 1])
        if stack[-1][1] == width[group]:
            stack.pop()
    return verdict


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan 2: (host, kind, key, order, pages or blocks, template blocks, characters).

    Kind 0: a class and its order on the pages; 1: an element and its text blocks; 2: a
    container and the characters of its slots outside links.
    """
    sums = Sums([pa.string(), pa.int32(), LONG, LONG], [LONG] * 3, ["host", "kind", "key", "ordered", "n", "template", "chars"])
    for part in C.slices(batches, "page"):
        for host, tokens, page in zip(part.column("host").to_pylist(), part.column("tokens").to_pylist(), pages_in(part, "page"), strict=True):
            member = {t["token"] & MASK: t["class"] for t in tokens or []}
            marks, blocks = scan(page)
            sequence, texts, b = [], [], 0
            for i in range(len(marks) + 1):
                while b < len(blocks) and blocks[b][0] == i:
                    token = token_of(blocks[b][1], blocks[b][6])
                    texts.append(member.get(token))
                    if token in member:
                        sequence.append((token, member[token]))
                    b += 1
                if i < len(marks):
                    token = number(marks[i][0])
                    if token in member:
                        sequence.append((token if marks[i][1] else token ^ CLOSES, member[token]))
            if PAGE in member:
                sequence = [(PAGE, member[PAGE]), *sequence]
            for group, verdict in nesting(sequence).items():
                sums.add((host, 0, group, verdict), 1, 0, 0)
            for group, (_, path, container, out, _, _, text, link) in zip(texts, blocks, strict=True):
                if not out:
                    sums.add((host, 1, signed(number(path)), group or 0), 1, 0, 0)
                    if group is None and 2 * link <= len(text):
                        sums.add((host, 2, signed(number(container)), 0), 0, 0, len(text))
        yield from sums.batches(HELD)
    yield from sums.batches()


def templates(pages: DataFrame) -> DataFrame:
    """One row per host: its valid classes, the elements that hold template text, and the container of the article."""
    known = classes(pages)
    tagged = pages.join(broadcast_checked(known), "host", "left").select("host", "tokens", "page")
    stats = tagged.mapInArrow(measured, "host string, kind int, key long, ordered long, n long, template long, chars long")
    stats = stats.groupBy("host", "kind", "key", "ordered").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    stats = C.written(stats, "slots")
    orders = stats.filter("kind = 0").groupBy("host", "key").agg(F.sum("n").alias("n"), F.max(F.when(F.col("ordered") != 0, F.col("n"))).alias("best"))
    valid = orders.filter(F.col("best") * 10 >= F.col("n") * 9).select("host", F.col("key").alias("ordered"), F.lit(True).alias("valid"))
    texts = stats.filter("kind = 1").join(valid, ["host", "ordered"], "left")
    fixed = texts.groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).alias("template"))
    fixed = fixed.filter(F.col("template") * 2 > F.col("n")).groupBy("host").agg(F.collect_list("key").alias("fixed"))
    best = stats.filter("kind = 2").groupBy("host").agg(F.max(F.struct("chars", "key"))["key"].alias("container"))
    groups = valid.groupBy("host").agg(F.collect_list("ordered").alias("valid"))
    return best.join(fixed, "host", "full_outer").join(groups, "host", "full_outer").join(known, "host", "full_outer")


def article(page: str, tokens: dict[int, int], valid: set[int], fixed: set[int], container: int | None) -> Iterator[tuple[str, str, bool]]:
    """(path, text, part of the article) of every text block of a page."""
    _, blocks = scan(page)
    slot = []
    for _, path, _, out, _, _, text, _ in blocks:
        template = number(path) in fixed and tokens.get(token_of(path, text)) in valid
        slot.append(not out and not template)
    if not any(slot):  # copies of one page: what recurs is the article
        slot = [not b[3] for b in blocks]
    own = [s and b[4] for s, b in zip(slot, blocks, strict=True)]
    if not any(own) and any(slot):
        # No article element: the container that holds most text of the host's slots, else of the page's.
        chars: Counter = Counter()
        for s, b in zip(slot, blocks, strict=True):
            if s and 2 * b[7] <= len(b[6]):
                chars[b[2]] += len(b[6])
        at = next((c for c in chars if number(c) == container), None) or max(chars, key=lambda c: (chars[c], c), default=None)
        own = [s and at is not None and (b[1] + "/").startswith(at + "/") and (10 * b[7] < 9 * len(b[6]) or b[5]) for s, b in zip(slot, blocks, strict=True)]
        if True in own:
            start = own.index(True)
            title = [i for i in range(start) if slot[i] and blocks[i][5]]
            if title and not any(own[i] and blocks[i][1].endswith("h1") for i in range(len(own))):
                own[title[-1]] = True
    for b, kept in zip(blocks, own, strict=True):
        yield b[1], b[6], kept


BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("kept", pa.bool_())]))


def extract(pages: DataFrame, url: str = "url", page: str = "html", blocks: bool = True) -> DataFrame:
    """All columns of every row, with ``text``, ``n_chars`` and, if asked for, ``blocks`` (path, text, kept) of the page.

    Null or empty pages have an empty text. Pages without a host form one host. Repeated
    rows are treated alike, an empty table gives an empty result, input columns with the
    names of new ones are replaced.
    """
    new = ["text", "n_chars", *(["blocks"] if blocks else [])]
    names = [c for c in pages.columns if c not in new]
    ready = pages.select(*[f"`{c}`" for c in names], host_of(pages[url].cast("string")).alias("_host"), C.text_or_empty(page).alias("_page"))
    known = templates(ready.select(F.col("_host").alias("host"), F.col("_page").alias("page")))
    known = broadcast_checked(known.select(F.col("host").alias("_host"), F.struct("tokens", "valid", "fixed", "container").alias("_known")))
    joined = ready.join(known, "_host", "left").select(*[f"`{c}`" for c in names], "_known", "_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "_page"):
            texts, found = [], []
            for known, page in zip(part.column("_known").to_pylist(), pages_in(part, "_page"), strict=True):
                known = known or {}
                tokens = {t["token"] & MASK: t["class"] for t in known.get("tokens") or []}
                fixed = {k & MASK for k in known.get("fixed") or []}
                container = known.get("container")
                done = list(article(page, tokens, set(known.get("valid") or []), fixed, container & MASK if container is not None else None))
                texts.append(" ".join(t for _, t, kept in done if kept))
                if blocks:
                    found.append([{"path": p, "text": t, "kept": k} for p, t, k in done])
            more = [pa.array(found, BLOCKS)] if blocks else []
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-2], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)), *more], names=[*names, *new])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[:-2])
    kind = ", blocks array<struct<path: string, text: string, kept: boolean>>" if blocks else ""
    return joined.mapInArrow(run, f"{kept}text string, n_chars long{kind}")


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, blocks=False).select("page_id", "url", "text", "n_chars")

