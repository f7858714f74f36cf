"""Main text of HTML pages, with site templates removed.

A page is parsed into elements. Each element's subtree has a hash of its tag, class, text and children; Spark counts
on how many different pages of its host a hash occurs, and subtrees found on a large share of a host's pages, or on
many of them, are that site's template and are deleted. What remains is the article, told by structure:

* Elements whose tag, role or style says so (menus, footers, asides, forms, scripts, hidden parts, ...) are out, and so are
  headers that belong to the page rather than to an article.
* A class or id that consists of words such as "sidebar" or "cookie" is a hint only. It takes a second sign to leave an
  element out: it is short or mostly links, and the smaller part of the page or outside its article; reader comments have to stand behind the text.
  Paragraphs, headings, lists' items and what holds a main heading are never left out by name.
* Among article and main elements those that hold the text count; where they hold next to none of it, the rest of the page does.
* On pages without them, lists and tables that are links only are menus.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_enough, text_key

# Names of HTML elements, and words of class, id and role names that hint at what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe textarea title nav footer aside form button select option input object embed applet svg canvas video audio map dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
HINTS = COMMENTS | frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion sponsor sponsored sponsors
cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail menu menus nav navbar navigation
breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations widget widgets pagination pager skip search toc""".split())
#: Words that say nothing beside a hint.
NEUTRAL = frozenset("area articles bar block bottom box container content global inner left links list main outer page post posts primary reader right secondary section site slot stories thread top unit user wrap wrapper".split())
#: What a hint is looked for on.
CONTAINERS = frozenset("div section ul ol dl table header article center fieldset details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What follows a header that belongs to its article.
TEXTUAL = HEADINGS | frozenset("p ul ol dl blockquote pre figure table".split())
#: Words of a short element; words of a block of prose at least.
SHORT, PROSE = 40, 12
#: An open element of the key is ended by the start of one of the values.
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: What a start tag can end.
ENDS = {tag: [open_ for open_, by in ENDED_BY.items() if tag in by] for tag in {t for by in ENDED_BY.values() for t in by}}
#: An end tag or an implied end does not reach beyond these.
WALLS = frozenset("table td th ul ol dl html body article main nav aside footer section".split())

_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG, _QUOTE_OR_END, _ASSIGNED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile("[\"'>]"), re.compile(r"=\s*\Z")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "parts", "out", "scope", "names", "hash", "open", "words", "linked", "links", "prose", "titled")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.parts, self.hash, self.open = tag, [], 0, True
        role = attrs.get("role", "").lower()
        self.names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", ""))
        self.out = tag in DROPPED or role in ROLES or bool(hidden)
        self.scope = tag in ("article", "main") or role in ("main", "article")

    def hints(self) -> set[str]:
        """The hints among its names: a name is one if all its words are hints or neutral, and one at least is a hint."""
        found: set[str] = set()
        for name in self.names.split():
            words = set(_WORDS.findall(_CAMEL.sub(" ", name).lower()))
            if words <= HINTS | NEUTRAL or all(w in HINTS or w in NEUTRAL or w.isdigit() for w in words):
                found |= words & HINTS
        return found


def tag_end(page: str, at: int, absent: dict[str, int]) -> int:
    """Where the tag that begins before ``at`` ends (behind its >), -1 if nowhere. A > in an attribute's quotes does not end it.

    absent: from where on a kind of quote does not occur; kept over a page, so that no rest is searched twice.
    """
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        if _ASSIGNED.search(page, max(0, m.start() - 8), m.start()) and at < absent.get(m[0], len(page) + 1):
            closing = page.find(m[0], at)
            if closing < 0:
                absent[m[0]] = at
            else:
                at = closing + 1
    return -1


def parse(page: str | None) -> Element:
    """The page's elements under a root element; text is decoded, comments are dropped, missing end tags are implied."""
    root = Element("", {})
    page = page or ""
    stack, at, size = [root], 0, len(page)
    open_: Counter = Counter()  # open elements by tag, so that nothing is looked for in vain
    vain: dict[str, tuple[int, Element]] = {}  # the wall that kept an end tag from its element
    absent: dict[str, int] = {}
    text_from = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            e.open = False
            open_[e.tag] -= 1
        del stack[i:]

    def text_until(end: int) -> None:
        if end > text_from:
            stack[-1].parts.append(html.unescape(page[text_from:end]))

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            text_until(start)
            if page.startswith(("<!-->", "<!--->"), start):
                at = page.index(">", start) + 1
            else:
                ends = [e + n for mark, n in (("-->", 3), ("--!>", 4)) if start < absent.get(mark, size + 1) and (e := _find(page, mark, start + 4, absent)) >= 0]
                at = min(ends, default=size)
            text_from = at
            continue
        if page.startswith(("<!", "<?"), start):
            text_until(start)
            cdata = page.startswith("<![CDATA[", start)
            end = page.find("]]>" if cdata else ">", start)
            if cdata:
                stack[-1].parts.append(page[start + 9 : end if end >= 0 else size])
            at = text_from = size if end < 0 else end + (3 if cdata else 1)
            continue
        m = _TAG.match(page, start)
        if m is None:
            at = start + 1
            continue
        at = tag_end(page, m.end(), absent)
        if at < 0:  # no tag ends behind this place: the rest is text
            break
        text_until(start)
        text_from = at
        tag = m[2].lower()
        if m[1]:
            before = vain.get(tag)
            if open_[tag] and not (before and before[0] == open_[tag] and before[1].open):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in WALLS and tag in INLINE | {"p", "li", "dt", "dd"}:
                        vain[tag] = open_[tag], stack[i]
                        break
        else:
            for i in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ENDS.get(tag, ())) else ():
                if tag in ENDED_BY.get(stack[i].tag, ()):
                    close(i)
                    break
                if stack[i].tag in WALLS:
                    break
            text = page[m.end() : at - 1]
            attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTR.findall(text))} if text and text != "/" else {}
            element = Element(tag, attrs)
            stack[-1].parts.append(element)
            if tag in RAW:
                ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                element.parts.append(page[at : ending.start() if ending else size])
                end = page.find(">", ending.end()) if ending else -1
                at = text_from = size if end < 0 else end + 1
            elif tag not in VOID:
                stack.append(element)
                open_[tag] += 1
    text_until(size)
    return root


def _find(page: str, mark: str, at: int, absent: dict[str, int]) -> int:
    found = page.find(mark, at)
    if found < 0:
        absent[mark] = at
    return found


def weigh(root: Element) -> Element:
    """Counts what is in each element, and sets ``out`` on what is not the article (see the module's text)."""
    order = elements(root)
    for e in reversed(order):  # children first
        e.words = e.linked = e.links = e.prose = 0
        e.titled = e.tag in HEADINGS
        if e.out:
            continue
        direct = direct_linked = 0
        for p in e.parts:
            if isinstance(p, str):
                direct += len(p.split())
            elif not p.out:
                e.linked += p.linked
                e.links += p.links
                e.titled = e.titled or p.titled
                if p.tag in INLINE:
                    direct += p.words
                    direct_linked += p.linked
                else:
                    e.words += p.words
                    e.prose += p.prose
        e.words += direct
        if e.tag == "a":
            e.linked, e.links = e.words, e.links + 1
        elif e.tag not in INLINE and direct >= PROSE and 2 * direct_linked < direct:
            e.prose += direct
    total = sum(p.words if isinstance(p, Element) else len(p.split()) for p in root.parts)
    scoped = any(e.scope and not e.out for e in order)
    before = 0  # words of the page before an element
    todo: list[tuple] = [(p, root, False, k) for k, p in reversed(list(enumerate(root.parts)))]
    while todo:
        e, parent, inside, k = todo.pop()
        if isinstance(e, str):
            before += len(e.split())
            continue
        if e.out:
            continue
        inside_here = inside or e.scope
        if e.tag == "header" and not inside:
            follows = any(isinstance(p, Element) and p.tag in TEXTUAL or isinstance(p, str) and p.split() for p in parent.parts[k + 1 : k + 4])
            e.out = not (e.titled and parent.tag not in ("", "html", "body") and follows)
        elif e.tag in CONTAINERS and not (e.scope and not inside):
            hints, few_links = e.hints() if e.names != " " else set(), not (e.links and 2 * e.linked >= e.words)
            if hints & COMMENTS:
                e.out = 0 < before and total - before - e.words <= before
            elif hints:
                e.out = not (e.titled and few_links) and (e.words <= SHORT or not few_links) and (2 * e.words <= total or scoped and not inside)
            elif not scoped and e.tag in ("ul", "ol", "dl", "table"):
                e.out = e.links >= 3 and e.linked == e.words and 2 * e.words <= total
        if e.out:
            continue
        todo += [(p, e, inside_here, k) for k, p in reversed(list(enumerate(e.parts)))]
    return root


def elements(root: Element) -> list[Element]:
    """All elements below the root, parents first."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        children = [p for p in e.parts if isinstance(p, Element)]
        out += children
        todo += children
    return out


def hash_subtrees(root: Element) -> list[Element]:
    """Gives each element the hash of its subtree; returns the elements that have text or children."""
    import xxhash

    order = elements(root)
    digest = xxhash.xxh3_64_intdigest
    for e in reversed(order):  # children first
        made = [e.tag, e.names]
        for p in e.parts:
            made.append(p.hash if isinstance(p, Element) else " ".join(p.split()))
        e.hash = digest(repr(made).encode("utf-8", "surrogatepass"))
    return [e for e in order if e.parts]


def article_roots(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> tuple[list[Element], list[Element]]:
    """The outermost article and main elements that hold the page's text, and those that do not; none of the first if the rest of the page does."""
    found, todo, rest = [], [root], [0, 0]
    while todo:
        direct = 0
        for p in todo.pop().parts:
            if isinstance(p, str):
                direct += len(p.split())
            elif not p.out and p.hash not in templates:
                if p.scope:
                    found.append(p)
                else:
                    todo.append(p)
        rest[0] += direct if direct >= PROSE else 0
        rest[1] += direct
    weight = (lambda e: e.prose) if rest[0] or any(e.prose for e in found) else (lambda e: e.words)
    largest = max((weight(e) for e in found), default=0)
    beside = rest[0] if rest[0] or any(e.prose for e in found) else rest[1]
    if not found or 4 * sum(map(weight, found)) < beside:
        return [], found
    return [e for e in found if 8 * weight(e) >= largest], [e for e in found if 8 * weight(e) < largest]


def blocks(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of the article in page order, white space inside each turned into single spaces."""
    roots, others = article_roots(root, templates)
    wanted, left_out = {id(e) for e in roots}, {id(e) for e in others}
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if words := "".join(now).split():
            out.append(" ".join(words))
        now.clear()

    todo: list[tuple] = [(root, not roots)]
    while todo:
        part, inside = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if inside:
                now.append(part)
        elif part.out or (part.hash in templates and part.tag not in ("html", "body", "article", "main")) or id(part) in left_out:
            if part.tag not in INLINE:
                flush()
        elif part.tag in ("br", "hr"):
            flush()
        else:
            inside = inside or id(part) in wanted
            if part.tag not in INLINE:
                flush()
                todo.append((None, inside))
            todo += [(p, inside) for p in reversed(part.parts)]
    flush()
    return out


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset(), partial: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's text. partial: hashes of templates of a part of the site.

    These go only where they are blocks, as words in bold or links recur in articles, and only if at least half of the
    page's words stay, as what recurs all together is a copied article.
    """
    root = weigh(parse(page))
    if templates or partial:
        found = hash_subtrees(root)
        partial = {e.hash for e in found if e.hash in partial and e.tag not in INLINE}
    text = " ".join(blocks(root, templates))
    if partial:
        less = " ".join(blocks(root, partial | set(templates)))
        if 2 * len(less.split()) >= len(text.split()):
            return less
    return text


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null for a url that is null or names none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", F.xxhash64(host))


def counted(root: Element) -> set[int]:
    """The subtree hashes of a page that can be template: those that no boilerplate rule drops with what is in them."""
    hash_subtrees(root)
    out, todo = set(), [root]
    while todo:
        for e in todo.pop().parts:
            if isinstance(e, Element) and not e.out:
                if e.parts:
                    out.add(e.hash)
                todo.append(e)
    return out


def subtrees(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(t, host, page, hs)``: the distinct subtree hashes of each page with a host, and a hash of what can be seen of it.

    host is a hash of the host's name, t that of the html.
    """
    base = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), text_key(F.col(html_col)).alias("t")).where("host IS NOT NULL")
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found, seen = [], []
            for page in b.column(1):
                root = weigh(parse(page.as_py()))
                found.append(sorted(map(signed, counted(root))))
                seen.append(signed(xxhash.xxh3_64_intdigest("\n".join(blocks(root)).encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(seen, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["t", "host", "page", "hs"])

    return base.mapInArrow(run, "t BIGINT, host BIGINT, page BIGINT, hs ARRAY<BIGINT>")


def templates(rows: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``(host, h, whole)``: the hashes of subtrees that are a site's template, and whether of the whole site.

    rows: as of subtrees(), of the pages of a host that look the same one. A template of the whole site is on the share
    ``min_share`` of its pages; one of a part is on ``min_pages`` pages times the binary logarithm of their number.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    seen = rows.select("host", F.explode("hs").alias("h"))
    whole = F.col("n") >= F.lit(min_share) * F.col("pages")
    return (seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).join(hosts, "host")
            .where(whole | (F.col("n") >= F.lit(min_pages) * F.log2("pages"))).select("host", "h", whole.alias("whole")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """``(id, url, text)`` for each page.

    A subtree found on ``min_pages`` different pages of a host and on the share ``min_share`` of them is template, and
    so, on large hosts, is one on a number of pages that grows with the logarithm of the host's (see templates() and
    main_text()); what the boilerplate rules drop anyway is not counted. A null or empty page has an empty text; a page
    whose url is null or names no host is a host of its own, so nothing recurs on it. Pages of a host that show the same
    text count as one; ids may be null; extra columns are ignored; an empty table gives no rows.
    """
    rows = checkpointed(subtrees(pages, url_col, html_col).dropDuplicates(["host", "t"]))
    often = checkpointed(templates(rows.dropDuplicates(["host", "page"]), min_pages, min_share))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    by_host = None
    if small_enough(often, broadcast_rows):  # pages need not move
        sets: dict[int, tuple[set, set]] = {}
        for r in often.collect():
            sets.setdefault(r["host"], (set(), set()))[not r["whole"]].add(r["h"] % 2**64)
        by_host = pages.sparkSession.sparkContext.broadcast(sets)
        joined = base.select("id", "url", "html", "host", F.lit(None).cast("array<bigint>").alias("whole"), F.lit(None).cast("array<bigint>").alias("part"))
    else:
        hit = rows.select("t", "host", F.explode("hs").alias("h")).join(often, ["host", "h"])
        gone = checkpointed(hit.groupBy("host", "t").agg(*[F.collect_list(F.when(c, F.col("h"))).alias(n) for n, c in (("whole", F.col("whole")), ("part", ~F.col("whole")))]))
        joined = base.withColumn("t", text_key(F.col("html"))).join(gone, ["host", "t"], "left").select("id", "url", "html", "host", "whole", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, host, whole, part in zip(*[b.column(k).to_pylist() for k in range(2, 6)]):
                found = by_host.value.get(host, (set(), set())) if by_host else [{h % 2**64 for h in hs or ()} for hs in (whole, part)]
                texts.append(main_text(page, *found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return joined.mapInArrow(run, f"{id_col} {base.schema['id'].dataType.simpleString()}, {url_col} string, text string")
