"""Main text of web pages, by template deduction over equivalence classes.

Pages of one host share a template.  Each page is cut into tokens: its container
tags, each known by the path on which it stands, and the texts under each path.
Tokens of a host with the same occurrence vector (how often each page holds them)
form an equivalence class; pages with the same html count once, and the vectors are
compared by sums of hashes.  A class is valid if it is

* frequent: its tags are on three pages at least and on a twentieth of the host's, and
  its texts on half of them;
* large: of three parts at least; a tag has two ends, its class names are a third
  part, and a text is one;
* ordered: on as many pages its tokens stand in one order, by their first places and
  by their last.

The valid classes nest by their tags' paths into the host's template.  A block of a
page fills the slot of the template's tags on its path.  A slot is closed if one of
these tags is marked (by class, id or role) as a menu, header, footer, sidebar, notice,
advert or comments: only a tag of the template closes what is under it, never one
that a page has for itself.  Text that is the template's own is left out, too.  All
other slots are open, and the main text is what fills them.  Inside an article
(``article``, ``main`` or that role) text is never the template's own, as pages of one
host may hold copies of one article.

Elements that HTML itself defines as no main text (``nav``, ``aside``, ``form``,
``footer``, scripts, controls and the like; ``header`` outside of an article) are left
out on every page.  A page of a host without a template counts as its own: all its
marked containers close, and if it has an article, that alone is its text.

Null html is empty; so is the text of a page without any.  A page with a null url
belongs to the host of the empty name.  Broken markup is read as browsers do:
unclosed elements end with their parent or the page, an unclosed comment or tag
swallows the rest.  Repeated pages are each returned; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Scratch, batches, beside, slim_batches, texts_of

#: Elements by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol dl menu table dialog figure details fieldset search template".split())
LEFT_OUT = frozenset("head nav header footer aside form script style noscript template iframe noembed noframes button select textarea menu dialog svg canvas object audio video search".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES_OUT = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification pagination popup promo promotion promoted related replies respond share sharing sidebar sidebars skip social sponsor sponsored subscribe tags toolbar widget".split()
)
_KNOWN = BLOCKS | CONTAINERS | LEFT_OUT
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The rest of a tag: no backtracking, as its parts exclude each other.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?![\s"'])))*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\x20\t\n\r\f\x0b\x85\xa0]+|\s+")
_NUMBERED = re.compile(r"\S*\d\S*")
#: A token's number if it is a tag: one that is marked, or another.
TAG, MARKED = 0, -1


def host_column(url: str):
    """A page's host in small letters; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


class Element:
    """An open container: a hash of its path, whether it is in an article, marked, or no main text by its tag."""

    __slots__ = ("name", "path", "parent", "article", "marked", "gone")

    def __init__(self, name: str, path: int, parent: Element | None, article: bool, marked: bool, gone: bool):
        self.name, self.path, self.parent, self.article, self.marked, self.gone = name, path, parent, article, marked, gone


class Block:
    """A run of text and the container in which it stands."""

    __slots__ = ("at", "text")

    def __init__(self, at: Element, text: str):
        self.at, self.text = at, text

    @property
    def token(self) -> int:
        return _hash(self.text) or 1


def _named(name: str, attributes: str) -> tuple[str, bool, bool]:
    """A container's label (tag and class names without numbers), whether it is marked, and whether it has an article's role."""
    label, marked, article = name, False, name in ("article", "main")
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "class":
                label = f"{name}.{'.'.join(_NUMBERED.sub('', value).split())}"
            words = value.lower()
            if kind == "role":
                marked |= words.strip() in ROLES_OUT
                article |= words.strip() in ("article", "main")
            elif name not in ("html", "body"):
                marked |= not CLASSES_OUT.isdisjoint(re.split(r"[^a-z0-9]+", words))
    return (f"{label}!" if marked else label), marked, article


#: Hashes of paths by parent and label, for those that come again; bounded.
_PATHS: dict[tuple[int, str], int] = {}


def _path(parent: int, label: str) -> int:
    found = _PATHS.get((parent, label))
    if found is None:
        if len(_PATHS) >= 50_000:
            _PATHS.clear()
        found = _PATHS[parent, label] = _hash(parent, label)
    return found


def parse(page: str) -> list[Element | Block]:
    """The page's containers, where they begin, and its text blocks, in order; references decoded, white space made one space."""
    out: list[Element | Block] = []
    stack = [Element("", 0, None, False, False, False)]
    open_: dict[str, int] = {}
    held: list[str] = []

    def close_block() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip(" ")
            held.clear()
            if text and not stack[-1].gone:
                out.append(Block(stack[-1], text))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                held.append("<")
                at = lt + 1
            continue
        name = m[1].lower()
        rest = _REST.match(page, m.end())
        # An unclosed quotation ends with the tag; there is one of each kind at most in a page.
        at = rest.end() if rest else page.find(">", m.end()) + 1 or size
        if name not in _KNOWN and name not in RAW:
            if name == "br":
                held.append(" ")
            continue
        attributes = page[m.end() : at - 1]
        if page[lt + 1] == "/":
            if name in BLOCKS or name in CONTAINERS:
                close_block()
            if open_.get(name):
                while True:
                    gone = stack.pop()
                    open_[gone.name] -= 1
                    if gone.name == name:
                        break
            continue
        if name in BLOCKS or name in CONTAINERS:
            close_block()
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
            continue
        if name in VOID:
            continue
        if name in CONTAINERS or name in LEFT_OUT:
            up = stack[-1]
            label, marked, article = _named(name, attributes)
            article |= up.article
            element = Element(name, _path(up.path, label), up, article, marked, up.gone or name in LEFT_OUT and not (name == "header" and article))
            stack.append(element)
            open_[name] = open_.get(name, 0) + 1
            if not element.gone:
                out.append(element)
    close_block()
    return out


def page_tokens(items: list[Element | Block]) -> dict[tuple[int, int], list[int]]:
    """Tokens of a page, (path, number), to their count, first and last place; text inside an article is none."""
    found: dict[tuple[int, int], list[int]] = {}
    for place, x in enumerate(items):
        if isinstance(x, Element):
            token = (x.path, MARKED if x.marked else TAG)
        elif x.at.article:
            continue
        else:
            token = (x.at.path, x.token)
        seen = found.get(token)
        if seen is None:
            found[token] = [1, place, place]
        else:
            seen[0] += 1
            seen[2] = place
    return found


_TOKENS = "host string, path long, token long, content long, n long, first long, last long"


def occurrences(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each token of each distinct page of a host: how often it stands there, and where; the token (0, 0) is on every page."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            seen: set[tuple[str, int]] = set()
            columns: list[list] = [[] for _ in range(7)]
            for host, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                content = _hash(text)
                if (host, content) in seen:
                    continue
                seen.add((host, content))
                tokens = page_tokens(parse(text))
                tokens[0, 0] = [1, -1, -1]
                for (path, token), counts in tokens.items():
                    for column, x in zip(columns, (host, path, token, content, *counts)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "path", "token", "content", "n", "first", "last"])

    # Copies of a page in other batches meet here, and count once.
    return pages.select(host_column(url).alias("host"), html).mapInArrow(run, _TOKENS).distinct()


def candidate_classes(tokens: DataFrame, text_share: float = 0.5, tag_share: float = 0.05, least_pages: int = 3, least_size: int = 3) -> DataFrame:
    """From :func:`occurrences`: ``host, class, least, path, token`` of the members of frequent and large classes, ``least`` being the pages asked for."""
    counts = tokens.groupBy("host", "path", "token").agg(F.count("*").alias("pages"), F.sum(F.shiftrightunsigned(F.xxhash64("content", "n"), 33)).alias("print"))
    sizes = counts.where("path = 0 and token = 0").select("host", F.col("pages").alias("of"))
    share = F.when(F.col("token") > 0, F.lit(text_share)).otherwise(F.lit(tag_share))
    # Most tokens are on one page and go no further; of the rest each host has a page's worth, 1 / share times at most.
    often = beside(counts.where((F.col("path") != 0) & (F.col("pages") >= least_pages)), sizes, ["host"], ["path", "token"])
    often = often.withColumn("least", F.greatest(F.ceil(share * F.col("of")), F.lit(least_pages)).cast("long")).where("pages >= least")
    size = F.when(F.col("token") > 0, 1).when(F.col("token") == MARKED, 3).otherwise(2)
    classes = often.groupBy("host", F.xxhash64("pages", "print").alias("class")).agg(F.collect_list(F.struct("path", "token")).alias("members"), F.sum(size).alias("size"), F.max("least").alias("least"))
    return classes.where(F.col("size") >= least_size).select("host", "class", "least", F.explode("members").alias("m")).select("host", "class", "least", "m.*")


def valid_members(tokens: DataFrame, members: DataFrame, most_sent: int) -> DataFrame:
    """Of :func:`candidate_classes`, the members of ordered classes that decide about text: marked tags, and texts."""
    found = tokens.select("host", "path", "token", "content", "first", "last")
    keys = ["host", "path", "token"]
    found = found.join(F.broadcast(members), keys) if members.count() <= most_sent else beside(found, members, keys, ["content"])
    # One row a page and class: its tokens by first and by last place; as many as a page has.
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "path", "token"))), lambda x: F.struct(x["path"], x["token"]))
    pages = found.groupBy("host", "class", "content").agg(by("first").alias("a"), by("last").alias("b"), F.max("least").alias("least"))
    ordered = pages.where("a = b").groupBy("host", "class", F.xxhash64("a").alias("sequence")).agg(F.count("*").alias("pages"), F.max("least").alias("least")).where("pages >= least").select("host", "class").distinct()
    return members.join(ordered, ["host", "class"], "left_semi").select("host", "path", "token")


def templates(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html", most_sent: int = 100_000) -> DataFrame:
    """Per host with a template: ``host`` and its ``members``, an array of (path, token): of its tags those that are marked, and its texts."""
    tokens = scratch.keep(occurrences(pages, url, html), "tokens")
    members = scratch.keep(candidate_classes(tokens), "classes")
    found = scratch.keep(valid_members(tokens, members, most_sent), "members")
    scratch.drop(tokens, members)
    decide = F.when(F.col("token") != TAG, F.struct("path", "token"))
    out = scratch.keep(found.groupBy("host").agg(F.collect_list(decide).alias("members")), "templates")
    scratch.drop(found)
    return out


def main_text(items: list[Element | Block], template: frozenset[tuple[int, int]] | None) -> str:
    """The page's main text: what fills the slots that its host's template leaves open; None: the page is its own template."""
    closed: dict[int, bool] = {}

    def shut(e: Element) -> bool:
        chain = []
        while e is not None and id(e) not in closed:
            chain.append(e)
            e = e.parent
        is_closed = closed[id(e)] if e is not None else False
        for e in reversed(chain):
            is_closed = closed[id(e)] = is_closed or e.marked and (template is None or (e.path, MARKED) in template)
        return is_closed

    blocks = [x for x in items if isinstance(x, Block) and not shut(x.at)]
    if template is None:
        return "\n".join(b.text for b in ([b for b in blocks if b.at.article] or blocks))
    return "\n".join(b.text for b in blocks if b.at.article or (b.at.path, b.token) not in template)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_sent: int = 100_000, found: DataFrame | None = None) -> DataFrame:
    """Per page: key, url, ``text`` (blocks joined by one line end) and ``n_chars``.

    Templates of at most ``most_sent`` tokens in all are broadcast; more are joined to
    their hosts' pages.  ``found`` may give templates as :func:`templates` returns them.
    """
    spark = pages.sparkSession
    slim_batches(spark, 512)
    pages = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"))
    if found is None:
        found = templates(pages, Scratch(spark, "templates"), "u", "h", most_sent)
    pages = pages.withColumn("host", host_column("u"))
    schema = T.StructType([T.StructField(key, pages.schema["k"].dataType), T.StructField(url, pages.schema["u"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    as_set = lambda members: frozenset((m["path"], m["token"]) for m in members)
    size = found.agg(F.sum(F.size("members") + 1)).first()[0] or 0
    sent = None
    if size <= most_sent:
        sent = spark.sparkContext.broadcast({r.host: as_set(r.members) for r in found.toLocalIterator()})
    else:
        pages = beside(pages, found.select("host", "members"), ["host"], ["k", "u"], "left").select("k", "u", "h", "host", "members")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset | None] = {}

        def template_of(host: str, batch: pa.RecordBatch, row: int) -> frozenset | None:
            if sent is not None:
                return sent.value.get(host)
            if host not in known:
                if len(known) >= 256:
                    known.clear()
                members = batch.column(4)[row].as_py()
                known[host] = None if members is None else as_set(members)
            return known[host]

        for batch in batches(rows):
            texts = [main_text(parse(page), template_of(host, batch, i)) for i, (host, page) in enumerate(zip(batch.column(3).to_pylist(), texts_of(batch.column(2))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
