"""Operator 2: main text of HTML pages as the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags. A word weighs as its element does (the log odds that words there belong
to the main text; words of links are a little against it, as menus are made of them), a tag weighs less than nought, the
more so the less it occurs inside main text, and very little inside elements of other purpose. A single scan over the
sequence finds the contiguous run of the largest sum (`best_run`), which is widened to whole blocks; its text, without
what stands in elements of other purpose inside it, is the result. Lists, small blocks and links inside the run are part
of it.

A page's only <article> (or, without one, its only <main>), if it holds any words, says itself what the main text is:
there words weigh 1 and nothing less than nought, and all else counts against it, so that the best run is the element, whole. On other pages the
weights decide.

Weights are learned from labelled pages: pages of the table itself whose markup names the main text by exactly one
<article> element, at most about `sample_pages` of them, chosen by a hash of page_id. Elements with a class, id or role
are counted by their names, others by what stands around them, so that a list in a menu says nothing of one in a text;
tags are counted where no element of other purpose is around them. A named element whose words are mostly outside of main text is of other
purpose. Elements and classes that those pages lack get the weights of FURNITURE (names of menus, adverts, notices,
comments and the like) or, for anything else, of main text; a learned weight for main text wins over FURNITURE. A page's only <article>, <main>, the body and what is
around an <article> or <main> never count as of other purpose, nor do headings in the <header> of an <article> or
<main>. A page that has no main text by these names is read again without regard to classes, ids and roles. The weights
sent to the tasks are those of the sampled pages' elements.

Inside a block white space becomes one space; blocks are joined by one space in page order. Character references are
decoded. Scripts, styles, comments and other elements without text for readers are never part of the text.

Defined results: null, empty and tagless input gives what text there is (empty for null and empty). Unclosed elements
end with their parent; an unclosed script, style or comment ends with the page, an unclosed head where something begins
that can't stand in a head. Of other elements without text for readers that aren't closed, only the tag is dropped. Of
runs with equal sums the first and longest is taken. Repeated rows get equal results. Other columns are kept, but one
named text is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Fixed: elements that hold no text for readers.
RAW = "script|style|noscript|template|svg|textarea|iframe|object|canvas|select"
#: Fixed: those of them that may stand in a head, with the other elements that may.
HEAD = frozenset("script style noscript template title meta link base head html".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
#: Fixed: elements that stand in a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins math mi mn mo mrow msub msup mfrac msqrt mtext kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that group others; only these can hold text of other purpose.
GROUP = frozenset("address article aside blockquote body center dialog details div dl fieldset figure footer form header main menu nav ol section table ul button".split())
#: Fixed: names of elements, and words in class, id and role, that tell of something beside the main text.
FURNITURE_TAGS = frozenset("nav header footer aside form menu button dialog fieldset".split())
FURNITURE = re.compile(
    r"[\s_-](?<![\s_-]no[_-])(?<![\s_-]has[_-])(?<![\s_-]with[_-])(?<![\s_-]without[_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumbs?|byline|adsbygoogle|comments?|commentlist|consent|cookies?|cookiebanner|cookiebar|copyright|disqus|footer|gdpr|header|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|overlay|paywall|notice|notices|notification|pagination|pager|popup|promo|promoted|related|replies|reply|respond|search|share|sharing|sidebar|sidenav|signup|skip|social|sponsor|sponsored|subscribe|tags|toc|toolbar|topbar|topnav|widget|alert|complementary|contentinfo|search)(?=$|[\s_-])",
    re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed: elements at which an unclosed link ends.
ENDS_LINK = frozenset("p li td th tr ul ol dl dt dd table pre hr".split())
#: Fixed: headings.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Weights of words of main text and of other text by name, of words of links, of tags inside elements of other purpose and
#: links, and of tags that labelled pages lack; the least that an element without names weighs.
IN, OUT, LINK, PASSED, TAG = 1.0, -0.02, -0.04, -0.02, -0.04
PLAIN = 0.1


#: Kinds of elements.
MAIN, HEAD_OF_MAIN, OTHER = 0, 1, 2


def _furniture(tag: str, names: str) -> bool:
    return tag in FURNITURE_TAGS or bool(names and FURNITURE.search(f" {names}"))


def tokens(page: str | None):
    """The matches of TOKEN, without what stands in a head or in elements of RAW."""
    page = page or ""
    at, head, title = 0, False, False
    unclosed: set[str] = set()
    while m := TOKEN.match(page, at):
        at = m.end()
        raw, name = (m.group(1) or "").lower(), (m.group(3) or "").lower()
        if raw and raw not in unclosed and not (raw == "svg" and m.group(0).endswith("/>")):
            if end := re.compile(rf"</{raw}\s*>", re.I).search(page, at):
                at = end.end()
            elif raw in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(raw)
        if head:
            if name or raw:
                head = not (name == "head" and m.group(2)) and (bool(m.group(2)) or (name or raw) in HEAD)
                title = name == "title" and not m.group(2)
                if head or name == "head":
                    continue
            elif title or m.group(0).isspace() or m.group(0)[:2] in ("<!", "<?"):
                continue
            else:
                head = False
        elif name == "head":
            head = not m.group(2)
            if not head:
                continue
        yield m


def events(page: str | None, learned: dict[str, float] | None = None, by_name: bool = True):
    """Yields (kind, value, key, other, link, within): kind `tag` with its name, or `text` with the raw text; key names the
    innermost grouping element, other says if it or one around it names another purpose, link if it is in a link, within if
    it is in the page's only <article> (or else <main>), depth-first in page order. `learned` has the weights of keys;
    without `by_name` classes, ids and roles say nothing."""
    found = list(tokens(page))
    opened = {tag: [n for n, m in enumerate(found) if (m.group(3) or "").lower() == tag and not m.group(2)] for tag in ("article", "main")}
    lone = len(opened["article"]) == 1
    only = opened["article"][0] if lone else opened["main"][0] if len(opened["main"]) == 1 and not opened["article"] else -1
    around: set[int] = set()  # numbers of the tokens that open an element around <article> or <main>
    for main in (True, False):
        stack: list[tuple[str, str, int, int]] = [("", "", MAIN, -1)]
        link = heading = False
        for n, m in enumerate(found):
            token, name = m.group(0), m.group(3)
            before = stack[-1][2] == OTHER or (stack[-1][2] == HEAD_OF_MAIN and not heading)
            if name:
                tag = name.lower()
                if tag == "a":
                    link = not m.group(2) and "href" in m.group(4).lower()
                elif tag in ENDS_LINK:
                    link = False
                if tag in HEADINGS:
                    heading = not m.group(2)
                if m.group(2):
                    if tag in GROUP and any(s[0] == tag for s in stack):
                        link = False
                        while stack.pop()[0] != tag:
                            pass
                elif tag in GROUP and tag not in VOID and not m.group(4).endswith("/"):
                    if main:
                        if tag in ("article", "main"):
                            for s in reversed(stack):
                                if s[3] in around:
                                    break
                                around.add(s[3])
                            if tag == "main" or lone:
                                around.add(n)
                        stack.append((tag, "", MAIN, n))
                    else:
                        names = " ".join(x for g in NAMED.findall(m.group(4)) for x in g if x) if by_name else ""
                        key = f"{tag}.{names.lower()}" if names else ">".join([*stack[-1][1].split(">")[-2:], tag])
                        kind = MAIN
                        weight = learned.get(key, 0) if learned else 0
                        if tag != "body" and n not in around and (weight < 0 and names or _furniture(tag, names) and weight <= 0):
                            own = tag == "header" and not _furniture("", names) and any(s[0] in ("article", "main") for s in stack)
                            kind = HEAD_OF_MAIN if own else OTHER
                        stack.append((tag, key, max(kind, stack[-1][2]), n))
            if main:
                continue
            within = only >= 0 and any(s[3] == only for s in stack)
            other = stack[-1][2] == OTHER or (stack[-1][2] == HEAD_OF_MAIN and not heading)
            if name or m.group(1):
                yield "tag", (name or m.group(1)).lower(), stack[-1][1], other or before, link, within
            elif token[0] != "<" or token == "<":
                yield "text", token, stack[-1][1], other, link, within


def counted(page: str | None) -> dict[tuple[str, str], list[int]]:
    """For a labelled page: how often each tag and each element's words occur outside and inside the main text."""
    out: dict[tuple[str, str], list[int]] = {}
    if page is None or len(re.findall(r"<article\b", page, re.I)) != 1:
        return out
    for kind, value, key, other, _, within in events(page):
        if kind == "tag":
            if not other:
                out.setdefault(("tag", value), [0, 0])[within] += 1
        elif n := len(value.split()):
            out.setdefault(("word", key), [0, 0])[within] += n
    return out


class Weights:
    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.word, self.tag = {}, {}
        for kind, key, outside, inside in rows:
            odds = math.log((inside + 1) / (outside + 1))
            if kind == "word":
                self.word[key] = max(-3.0 if "." in key else PLAIN, min(IN, odds))
            else:
                self.tag[key] = min(TAG, max(-3.0, odds + TAG))

    def of_word(self, key: str, other: bool) -> float:
        return OUT if other else self.word.get(key, IN)

    def of_tag(self, tag: str, other: bool) -> float:
        return PASSED if other else self.tag.get(tag, -1.0 if tag in FURNITURE_TAGS else TAG)


def best_run(gains: list[float]) -> tuple[int, int]:
    """The run with the largest sum, as start and end; of equal sums the first, and of those that begin there the longest.
    (0, 0) if no sum is over nought."""
    best = total = 0.0
    begin, span = 0, (0, 0)
    for i, gain in enumerate(gains):
        if total <= 0:
            total, begin = 0.0, i
        total += gain
        if total > best or (total == best and span[0] == begin and best > 0):
            best, span = total, (begin, i + 1)
    return span


def main_text(page: str | None, weights: Weights, by_name: bool = True) -> str:
    """The text of the best run."""
    parts: list[str] = []  # texts, \x00 for the end of a block
    held: list[bool] = []  # if it isn't of other purpose
    gains: list[float] = []
    found = list(events(page, weights.word, by_name))
    named = any(kind == "text" and within and not other and value.strip() for kind, value, _, other, _, within in found)
    for kind, value, key, other, link, within in found:
        if kind == "text":
            text = html.unescape(value)
            weight = weights.of_word(key, other)
            if named:
                weight = (0.0 if other else IN) if within else -1.0
            elif link and not other:
                weight = min(weight, LINK)
            parts.append(text.replace("\x00", " "))  # the input's own is no text
            held.append(not other)
            gains.append(len(text.split()) * weight)
        else:
            parts.append("" if value in INLINE else "\x00")
            held.append(True)
            gains.append((0.0 if within else -1.0) if named else weights.of_tag(value, other or link))
    start, end = best_run(gains)
    while 0 < start < end and parts[start - 1] != "\x00":  # whole blocks
        start -= 1
    while start < end < len(parts) and parts[end - 1] != "\x00":
        end += 1
    blocks = "".join(t for t, ok in zip(parts[start:end], held[start:end], strict=True) if ok).split("\x00")
    out = " ".join(x for b in blocks if (x := " ".join(b.split())))
    return main_text(page, weights, False) if not out and by_name else out


def extract(pages: DataFrame, sample_pages: int = 2000, keep: list[str] | None = None) -> DataFrame:
    """pages (page_id, html, ...) -> the columns `keep` with text."""
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    labelled = pages.filter(F.coalesce(F.col("html"), F.lit("")).rlike("(?i)<article\\b"))
    n = labelled.select("page_id").count()
    share = min(1.0, sample_pages / max(n, 1))
    sample = labelled.filter((F.xxhash64("page_id") / F.lit(2.0**64) + 0.5) < F.lit(share + (share == 1.0))).select("html")

    def count(batches):
        for batch in batches:
            total: dict = {}
            for page in batch.column(0).to_pylist():
                for k, (a, b) in counted(page).items():
                    t = total.setdefault(k, [0, 0])
                    t[0] += a
                    t[1] += b
            yield pa.record_batch([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["kind", "key", "outside", "inside"])

    counts = sample.mapInArrow(count, "kind string, key string, outside long, inside long").groupBy("kind", "key").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    rows = counts.orderBy("kind", "key").collect()  # the elements of about sample_pages pages
    sent = pages.sparkSession.sparkContext.broadcast(Weights([tuple(r) for r in rows]))

    def run(batches):
        for batch in batches:
            source = batch.column(len(keep))
            for k in range(0, batch.num_rows, 1000):
                own = batch.slice(k, 1000)
                text = [main_text(p, sent.value) for p in source.slice(k, 1000).to_pylist()]
                yield pa.record_batch([*(own.column(c) for c in range(len(keep))), pa.array(text, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col("html").alias(fresh("html", keep))).mapInArrow(run, pages.select(*keep).schema.add("text", "string"))


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_main_text": op2_main_text}
SQL: dict[str, str] = {}
