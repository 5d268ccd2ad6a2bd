"""HTML extraction: the main text of pages, with site templates removed.

A tolerant parser lists each page's elements in document order, each with the place where its subtree ends; all
passes are loops over that list, linear in the page and without a limit on depth.  Elements that are never article text (menus,
headers, footers, sidebars, forms, scripts, adverts, notices, comments, by tag, role, class or id)
go first.  Of what remains inside the article (or main, or body) every subtree that could be a template is hashed.

Spark counts for each host and subtree the distinct contents (hashes of the whole main text) and the distinct
names of the pages that have it.  A name is the smallest hash of the main text's word triples, so most
near copies of one article share it, while different articles have different ones.  A subtree is a template if it recurs under MIN_NAMES names, whatever the
size of the host, and its names are MIN_VARIETY of its contents at least: a paragraph of a much copied and edited
article has many contents and few names.  Templates are deleted from their host's pages.

Inside an article headings, list items, table cells and inline marks are content even where pages share them; a paragraph
or quotation of at most SHORT words, or the first or last in the article, is a template only if MIN_SHARE of the host's contents have it
(a notice in every article; a line that some articles share is theirs); structures around them are like what stands outside articles, where all elements can be templates.

The counts come from map-side combined aggregations by (host, subtree, content), so a hot host is many keys.  Templates whose
counted rows are few are broadcast to the second pass; more are joined to the pages, each page with a list of
at most its own subtrees.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated
pages give equal rows; an empty table gives no rows; other columns are ignored; very long pages are
parsed whole, one at a time; a tag that never ends hides what follows it, and a quote that never ends is taken as text of its tag.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, stored, table
from .media import flushed

#: Names under which a template recurs at least, their least share of its contents; words of a paragraph that can be one anywhere in
#: an article, and the least share of the host's contents that such a one is in.
MIN_NAMES, MIN_VARIETY, SHORT, MIN_SHARE = 10, 0.25, 40, 0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>?|[^<]+|<(?![a-zA-Z])|<(?=[a-zA-Z])""", re.S)
#: The same where a quote is no more than a character: a tag ends at the next >.
PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|[^<]+|<(?![a-zA-Z])|<(?=[a-zA-Z])""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|\Z))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav footer aside form button select option input menu dialog object embed audio video canvas head fieldset datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|footer|site-?header|page-?header|header|masthead|topbar|sidebar|side-?bar|aside|ads?|advert\w*|ad-?\w*slot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|pop-up|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|social|share|sharing|related|recommend\w*|breadcrumbs?|pagination|pager|comments?|commentlist|comment-\w+|reply|replies|respond|disqus|discussion|widget|toolbar|skip-?link|copyright|legal|disclaimer|search\w*|form)(?:$|[\s_-])",
    re.I,
)
#: Start tags that end an open element of the given kinds.
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th tbody thead tfoot".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
#: What can't be a template inside an article, and what can be one there if it is short or at the edge.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr figcaption caption br".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())


def boilerplate(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes:
        return False
    role = marks = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            marks += f" {value}"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    if tag == "article" and re.search(r"(?:^|[\s_-])comment", marks, re.I):
        return True
    return role in ROLES or bool(marks) and tag not in ("html", "body", "article", "main") and bool(MARKS.search(marks))


class Page:
    """Elements and texts of a page in document order: tags (None for a text), data (attributes or text), and ends (where
    the subtree ends); element 0 is the page.  gone marks the roots of deleted subtrees."""

    def __init__(self, text: str):
        self.tags: list[str | None] = ["html"]
        self.data, self.ends, self.gone = [""], [0], bytearray(1)
        stack = [0]
        opened: dict[str, list[int]] = {"html": [0]}  # places in the stack, by tag
        blocks = [0]  # those of elements that are neither inline nor p

        def close(place: int) -> None:
            """Close the elements from this place of the stack on."""
            while len(stack) > place:
                x = stack.pop()
                self.ends[x] = len(self.tags)
                opened[self.tags[x]].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()

        def last(tag: str) -> int:
            return opened[tag][-1] if opened.get(tag) else 0

        at, token, cut, end = 0, TOKEN, text.rfind(">"), len(text)
        while at < end:
            found = token.match(text, at)
            tag = found[2]
            if tag is None:
                part = found[0]
                if part == "<" and text[at + 1 : at + 2].isalpha() and text[at + 1].isascii():  # a tag that does not end
                    if at > cut:
                        break
                    token = PLAIN
                    continue
                at = found.end()
                if part[0] != "<" or part == "<":
                    self.add(None, part)
                continue
            at, tag, attributes = found.end(), tag.lower(), found[3]
            if found[1]:
                if last(tag):
                    close(last(tag))
                continue
            if tag in ("html", "body") and len(stack) <= 2 and (tag == "html" or last(tag)):
                continue
            ends = SIBLINGS.get(tag)
            if ends:  # an open sibling or p ends, unless a list stands between
                place = max(map(last, ends))
                if tag in PARAGRAPH_ENDS:
                    place = max(place, last("p"))
                if place > max(map(last, LISTS)):
                    close(place)
            elif tag in PARAGRAPH_ENDS and last("p") > blocks[-1]:
                close(last("p"))
            node = self.add(tag, attributes)
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "math", "path"):
                continue
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
                at = shut.end() if shut else end
                continue
            if tag not in INLINE and tag != "p":
                blocks.append(len(stack))
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
        close(0)
        self.clean()

    def add(self, tag: str | None, data: str) -> int:
        self.tags.append(tag)
        self.data.append(data)
        self.ends.append(len(self.tags))
        self.gone.append(0)
        return len(self.tags) - 1

    def clean(self) -> None:
        """Delete boilerplate; a header inside an article keeps its headings."""
        inside = header = heading = 0  # where the outermost open article, header in it and heading end
        i = 1
        while i < len(self.tags):
            tag = self.tags[i]
            if tag is None:
                self.gone[i] = heading <= i < header
            elif tag == "header" and i < inside:
                header = max(header, self.ends[i])
            elif tag == "header" or boilerplate(tag, self.data[i]):
                self.gone[i] = 1
            elif tag == "article":
                inside = max(inside, self.ends[i])
            elif tag in HEADINGS and i < header:
                heading = max(heading, self.ends[i])
            i = self.ends[i] if self.gone[i] else i + 1

    def outermost(self, wanted) -> list[int]:
        out, i = [], 1
        while i < len(self.tags):
            found = not self.gone[i] and self.tags[i] is not None and wanted(self.tags[i], self.data[i])
            if found:
                out.append(i)
            i = self.ends[i] if found or self.gone[i] else i + 1
        return out

    def parts(self) -> list[int]:
        """The outermost articles, else main elements, else the whole page."""
        main = lambda tag, data: tag == "main" or "role" in data and re.search(r"""\brole\s*=\s*["']?main\b""", data, re.I)
        return self.outermost(lambda tag, _: tag == "article") or self.outermost(main) or [0]

    def inside(self, part: int):
        """The nodes of a part that are not deleted."""
        i = part + 1
        while i < self.ends[part]:
            if self.gone[i]:
                i = self.ends[i]
            else:
                yield i
                i += 1

    def subtrees(self, part: int) -> dict[int, int]:
        """Hashes of those elements of a part that have text and can be templates; those of paragraphs in an article are odd, others even."""
        out, kinds = {}, {}
        stack = [(part, hashlib.blake2b(b"", digest_size=8), [0])]  # node, state, words
        article = part > 0

        def shut(i: int) -> None:
            while len(stack) > 1 and self.ends[stack[-1][0]] <= i:
                x, state, words = stack.pop()
                digest = state.digest()
                stack[-1][1].update(b"\0e" + digest)
                stack[-1][2][0] += words[0]
                if words[0]:
                    out[x], kinds[x] = int.from_bytes(digest, "big", signed=True), words[0]

        texts = []
        for i in self.inside(part):
            shut(i)
            tag = self.tags[i]
            if tag is None:
                words = self.data[i].split()
                stack[-1][1].update(b"\0t" + " ".join(words).encode("utf-8", "surrogatepass"))
                stack[-1][2][0] += len(words)
                if words:
                    texts.append(i)
            elif self.ends[i] == i + 1:
                stack[-1][1].update(b"\0v" + tag.encode())
            else:
                stack.append((i, hashlib.blake2b(tag.encode(), digest_size=8), [0]))
        shut(self.ends[part])
        if not article:
            return {x: digest & ~1 for x, digest in out.items()}
        edge = lambda x: x < texts[0] < self.ends[x] or x < texts[-1] < self.ends[x]
        can = lambda x: self.tags[x] not in INLINE and self.tags[x] not in CONTENT and (self.tags[x] not in PARAGRAPHS or kinds[x] <= SHORT or edge(x))
        return {x: digest | 1 if self.tags[x] in PARAGRAPHS else digest & ~1 for x, digest in out.items() if can(x)}

    def text(self, parts: list[int]) -> str:
        blocks: list[list[str]] = [[]]
        for part in parts:
            ends: list[int] = []  # of open block elements
            for i in self.inside(part):
                while ends and ends[-1] <= i:
                    ends.pop()
                    blocks.append([])
                tag = self.tags[i]
                if tag is None:
                    blocks[-1].append(references.unescape(self.data[i]))
                elif tag == "br":
                    blocks[-1].append(" ")
                elif tag not in INLINE:
                    blocks.append([])
                    ends.append(self.ends[i])
            blocks.append([])
        return " ".join(words for b in blocks if (words := " ".join("".join(b).split())))


def extract(html: str | None, templates=frozenset()) -> str:
    page = Page(html or "")
    parts = page.parts()
    if templates:
        for part in parts:
            for x, digest in page.subtrees(part).items():
                if digest in templates:
                    page.gone[x] = 1
    return page.text(parts)


def name_of(text: str) -> int:
    """The smallest hash of the text's word triples (of fewer words, all of them)."""
    words = text.encode("utf-8", "surrogatepass").split()
    return min(zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))


def host_of(url: str | None) -> str:
    return re.sub(r"^[^/]*//", "", url or "").split("/")[0].split("?")[0].rpartition("@")[2].lower()


def _subtrees(batches):
    """(url, html) -> host, subtree, content, name; each subtree of a page once."""
    schema = pa.schema([("host", pa.string()), ("subtree", pa.int64()), ("content", pa.int64()), ("name", pa.int64())])

    def rows():
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(html.as_py() or "")
                parts = page.parts()
                found = {digest for part in parts for digest in page.subtrees(part).values()}
                if found:
                    text, host = page.text(parts), host_of(url)
                    content = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    name = name_of(text)
                    for digest in {0, *found}:  # 0 stands for the page
                        yield 40, (host, digest, content, name)

    yield from flushed(rows(), schema)


def site_templates(pages: DataFrame) -> DataFrame:
    """host and subtree of the subtrees that a host repeats, stored."""
    found = pages.select("url", "html").mapInArrow(_subtrees, "host string, subtree long, content long, name long")
    # Copies of one content are one row from here on; most subtrees have one.
    one = stored(found.groupBy("host", "subtree", "content").agg(F.min("name").alias("name")), "subtrees")
    several = one.groupBy("host", "subtree").agg(F.count("*").alias("contents"), F.min("name").alias("low"), F.max("name").alias("high"))
    several = several.filter((F.col("contents") >= MIN_NAMES) & (F.col("low") < F.col("high"))).select("host", "subtree", "contents")
    several = stored(several, "repeated")
    names = one.join(several, ["host", "subtree"]).select("host", "subtree", "contents", "name").distinct()
    counted = names.groupBy("host", "subtree").agg(F.count("*").alias("names"), F.first("contents").alias("contents"))
    counted = counted.filter((F.col("names") >= MIN_NAMES) & (F.col("names") >= MIN_VARIETY * F.col("contents")) & (F.col("subtree") != 0))
    hosts = several.filter("subtree = 0").select("host", F.col("contents").alias("all_contents"))
    frequent = (F.col("subtree").bitwiseAND(F.lit(1)) == 0) | (F.col("contents") >= MIN_SHARE * F.col("all_contents"))
    return stored(counted.join(hosts, "host").filter(frequent).select("host", "subtree"), "templates")


def _extracted(held=None):
    """(page_id, url, html[, templates]) -> the result's rows; held: a broadcast of the hosts' templates, or None."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

        def rows():
            for batch in batches:
                ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, html in enumerate(batch.column(2)):
                    found = frozenset(batch.column(3)[i].as_py() or ()) if held is None else held.value.get(host_of(urls[i]), ())
                    text = extract(html.as_py(), found)
                    yield 4 * len(text), (ids[i], urls[i], text, len(text))

        yield from flushed(rows(), schema)

    return run


def _own_subtrees(batches):
    """(key, url, html) -> key, host, subtree."""
    schema = pa.schema([("key", pa.binary()), ("host", pa.string()), ("subtree", pa.int64())])

    def rows():
        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = Page(html.as_py() or "")
                for digest in {x for part in page.parts() for x in page.subtrees(part).values()}:
                    yield 60, (key, host_of(url), digest)

    yield from flushed(rows(), schema)


def main_text(pages: DataFrame, limit: int = SMALL) -> DataFrame:
    """page_id, url, text and n_chars of every page.  limit: bytes up to which templates are broadcast."""
    templates, result = site_templates(pages), "page_id long, url string, text string, n_chars long"
    if (templates.agg(F.sum(F.length("host") + 64)).first()[0] or 0) <= limit:
        by_host: dict[str, set[int]] = {}
        for host, subtree in templates.collect():
            by_host.setdefault(host, set()).add(subtree)
        held = pages.sparkSession.sparkContext.broadcast(by_host)
        return pages.select("page_id", "url", "html").mapInArrow(_extracted(held), result)
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha2(F.to_json(F.struct("url", "html")), 256)).alias("key"))
    own = keyed.select("key", "url", "html").mapInArrow(_own_subtrees, "key binary, host string, subtree long").join(templates, ["host", "subtree"])
    lists = stored(own.groupBy("key").agg(F.collect_set("subtree").alias("templates")), "page-templates")
    joined = keyed.join(lists, "key", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(_extracted(), result)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
