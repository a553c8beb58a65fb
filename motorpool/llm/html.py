"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts

#: Elements whose content is never text, elements without content, and elements inside a line.
RAW = frozenset("script style".split())
HIDDEN = frozenset("head noscript template svg math iframe object select option textarea button canvas audio video dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What a head may hold; anything else ends it. Elements that end a drawing or formula they start in,
#: and those inside which they do not.
HEAD = frozenset("head html title meta link base style script noscript template".split())
BREAKS = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul article main section".split())
HOLDS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: An element that ends when a like one starts, within the nearest of its containers.
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
LIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that are not the article, and words that say so where a class, id or role ends in them.
ASIDE = frozenset("nav aside form footer menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu "
    "modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar topbar widget".split()
)
#: Of these, what readers write; and words that say so only by their place or a repeated structure.
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
READER_WORDS = frozenset("conversation discuss discussion discussions feedback reactions respond responses reviews thread".split())
#: Words that may follow the one that counts (``comment-list``), and those that tell of a state (``has-sidebar``).
PART_WORDS = frozenset(
    "area bar block body bottom box button buttons column container content group holder icon icons inner item items js left link links list "
    "main message outer page panel post posts reader readers right row section site slot text title top unit user users wrap wrapper".split()
)
STATE_WORDS = frozenset("has no with without not non is hide hidden show enabled disabled open closed allow allows".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that repeat where readers' comments follow each other.
REPEATED = frozenset("div li article section dd".split())
#: A path is content from this share of the page's mean score, weighted by text.
THRESHOLD = 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，]")


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _names(attributes: str) -> Iterator[tuple[str, list[str]]]:
    """The names in class, id and role, each as its words."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in html.unescape(m[2] or m[3] or m[4] or "").split():
                yield m[1].lower(), _words(name)


def _tells(kind: str, words: list[str]) -> str | None:
    """The word by which a name says that its element is beside the article. It is the last one but
    for parts, as ``related-work`` is work; an id, often made of a heading, has no other words."""
    small = [w for w in words if not (w.isdigit() or len(w) == 1)]
    if not STATE_WORDS.isdisjoint(small):
        return None
    if kind == "id" and any(w not in ASIDE_WORDS and w not in READER_WORDS and w not in PART_WORDS for w in small):
        return None
    while len(small) > 1 and small[-1] in PART_WORDS and small[-1] not in ASIDE_WORDS:
        small.pop()
    return small[-1] if small and (small[-1] in ASIDE_WORDS or small[-1] in READER_WORDS) else None


class _Mark:
    """What is known of an element whose names say that it is beside the article."""

    __slots__ = ("comment", "weak", "inside", "topic", "plain", "holds", "first", "last", "repeats", "steps", "away")

    def __init__(self, told: list[tuple[str, list[str], str]], inside: set[str]):
        words = [word for _, _, word in told]
        self.comment = not COMMENT_WORDS.isdisjoint(words)
        self.weak = READER_WORDS.issuperset(words)
        self.inside = inside  # which of article and main are around it
        # Named by an id alone, it may be a section whose heading gave the name.
        self.topic = told[0][1] if all(kind == "id" for kind, _, _ in told) else None
        self.plain, self.holds, self.first, self.last = 0, False, None, -1
        self.repeats, self.steps = False, set()

    def judge(self, total: int, articles: set[str], after: int) -> None:
        """Sets whether the names are right; ``articles`` are the kinds that the page has, and
        ``after`` is where its last block without a mark is."""
        heads = self.first is not None and self.first["path"].rsplit("/", 1)[-1].split(".")[0] in HEADINGS
        topic = heads and not self.comment and self.topic == _words(self.first["text"])
        if self.holds:
            self.away = False
        elif self.weak:
            outside = bool(articles) and ("article" if "article" in articles else "main") not in self.inside
            self.away = outside or self.repeats or (self.last > after and not topic)
        elif topic and (self.inside or not articles):
            self.away = False
        elif self.comment:
            self.away = bool(articles) or self.plain < total
        else:
            self.away = (bool(articles) and not self.inside) or 2 * self.plain <= total


class _Page:
    """Blocks of one page in order, each with the path of elements it stands in."""

    def __init__(self, text: str):
        # Element, its step in the path, and whether it is beside the article: by its element, or a
        # mark where only its names say so.
        self.open: list[tuple[str, str, bool | _Mark]] = []
        self.articles: list[tuple[str, list[_Mark]]] = []  # each article and main, with the marks around it and its own
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.inline: dict[str, int] = {}  # open elements inside the line, by name
        self.hidden: list[str] = []  # the open element that hides its text, and those open in it
        self.blocks: list[dict] = []
        at = 0
        while m := _TAG.search(text, at):
            self.add(text[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            closes = bool(m[1] or m[4])
            if not name:
                continue
            if name in RAW and not closes:
                end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(text, at)
                at = end.end() if end else len(text)
            elif closes:
                self.hides_end(name) or self.close(name)
            else:
                attributes = m[3] or m[6] or ""
                self.hides_start(name, attributes.endswith("/")) or self.start(name, attributes)
        self.add(text[at:])
        self.flush()
        self.judge()

    def judge(self) -> None:
        """Marks that names gave go from what holds an article or main, of those with the fewest
        marks around them, or most of the page's text that is no link; those that tell of readers
        by what else speaks for it."""
        plain = [b["chars"] - b["linked"] for b in self.blocks]
        marks, after = [], -1
        for at, (block, n) in enumerate(zip(self.blocks, plain)):
            if not block["aside"]:
                after = at
            for mark in block["aside"]:
                if mark is not True:
                    if mark.first is None:
                        mark.first = block
                        marks.append(mark)
                    mark.last = at
                    mark.plain += n
        fewest = min((len(around) for _, around in self.articles), default=0)
        outer = [(name, around) for name, around in self.articles if len(around) == fewest]
        for mark in (mark for _, around in outer for mark in around):
            mark.holds = True
        for mark in marks:
            mark.judge(sum(plain), {name for name, _ in outer}, after)
        for block in self.blocks:
            block["aside"] = any(mark is True or mark.away for mark in block["aside"])

    def hides_start(self, name: str, empty: bool) -> bool:
        """Whether an element that starts is hidden; a hidden one that cannot hold it ends."""
        hidden = self.hidden
        if not hidden and name not in HIDDEN:
            return False
        if hidden:
            first = hidden[0]
            if first == "head":
                in_title = name in INLINE and hidden[-1] == "title"
                ends = name == "body" or (name not in HEAD and not in_title and HIDDEN.isdisjoint(hidden[1:]))
            elif first in ("svg", "math"):
                ends = name in BREAKS and HOLDS.isdisjoint(hidden)
            else:
                ends = False
            # A row, cell or item ends the like one before it, with what that has left open.
            if name in ENDS and first not in ("template", "noscript") and not ends:
                ends = set(ENDS[name]).isdisjoint(hidden) and self.find(LIKE.get(name, (name,)), ENDS[name]) >= 0
            if ends:
                hidden.clear()
                return self.hides_start(name, empty)
        if name in VOID or (empty and (name in HIDDEN or hidden[0] in ("svg", "math"))):
            return True
        if name == "select" and hidden and "select" in hidden:  # a select in a select is its end
            self.hides_end(name)
            return True
        if name == "option" and hidden and hidden[-1] == "option":
            hidden.pop()
        hidden.append(name)
        return True

    def hides_end(self, name: str) -> bool:
        """Whether an end tag is of a hidden element; that of an element around it ends it too."""
        hidden = self.hidden
        if not hidden:
            return name in HIDDEN
        for i in range(len(hidden) - 1, -1, -1):
            if hidden[i] == name:
                del hidden[i:]
                return True
        if name in HIDDEN or not (self.inline.get(name) if name in INLINE else self.find((name,), ()) >= 0):
            return True
        hidden.clear()
        return False

    def add(self, text: str) -> None:
        if self.hidden == ["head"] and text.strip():
            self.hidden.clear()
        if text and not self.hidden:
            self.parts.append(text)
            self.linked += len(text) * bool(self.links)

    def flush(self) -> None:
        # Character references are decoded after markup is gone, so what they spell is text.
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            steps = [step for _, step, _ in self.open]
            self.blocks.append({
                "path": "/".join(steps), "aside": [a for _, _, a in self.open if a], "text": text,
                "chars": len(text), "marks": len(_PUNCTUATION.findall(text)), "linked": min(self.linked, len(text)),
            })
        self.parts, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
        elif name in INLINE:
            self.links += name == "a"
            self.inline[name] = self.inline.get(name, 0) + 1
        elif name not in VOID:
            self.flush()
            self.links = 0
            self.inline.clear()
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            if name in ENDS:
                self.pop(LIKE.get(name, (name,)), ENDS[name])
            names = list(_names(attributes)) if "=" in attributes else []
            words = sorted({w for _, parts in names for w in parts})
            inside = {n for n, _, _ in self.open if n in ("article", "main")}
            told = [(kind, parts, word) for kind, parts in names if (kind != "id" or name not in HEADINGS) and (word := _tells(kind, parts))]
            around = [a for _, _, a in self.open if a]
            step = ".".join([name, *words])
            if words and name in REPEATED:
                for mark in around:
                    if mark is not True and mark.weak:
                        mark.repeats |= step in mark.steps
                        mark.steps.add(step)
            aside = name in ASIDE or (name == "header" and not inside)
            # Of articles only their own kind of names tells: a comment, an advert.
            if told and not aside and name not in ("html", "body", "main"):
                aside = _Mark(told, inside)
                around = [*around, aside]
            if name in ("article", "main") and True not in around:
                self.articles.append((name, around))
            self.open.append((name, step, aside))
        else:
            self.flush()

    def close(self, name: str) -> None:
        if name in INLINE:
            self.links = max(0, self.links - (name == "a"))
            self.inline[name] = max(0, self.inline.get(name, 0) - 1)
        else:
            self.flush()
            self.links = 0
            self.inline.clear()
            self.pop((name,), ())

    def find(self, names: tuple, within: tuple) -> int:
        """Where the innermost open element of these names is, or -1."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                return i
            if self.open[i][0] in within:
                break
        return -1

    def pop(self, names: tuple, within: tuple) -> None:
        """Ends the innermost open element of these names, with all inside it."""
        i = self.find(names, within)
        if i >= 0:
            del self.open[i:]


_BLOCK = pa.struct([("path", pa.string()), ("aside", pa.bool_()), ("text", pa.string()), ("chars", pa.int64()), ("marks", pa.int64()), ("linked", pa.int64())])
_BLOCKS = pa.schema([("page_id", pa.int64()), ("html_hash", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(_BLOCK))])


def blocks_of(pages: DataFrame) -> DataFrame:
    """The blocks of every page, markup and hidden elements gone, character references decoded."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", F.xxhash64("html").alias("html_hash"), "url")

    def rows(columns: list[list]) -> Iterator[tuple]:
        for page_id, text, html_hash, url in zip(*columns):
            yield page_id, html_hash, url, _Page(text or "").blocks

    return map_texts(read, rows, _BLOCKS)


def _smooth(column: str, order: W) -> Column:
    """A path's value with its neighbours' in page order at half weight; ends repeat themselves."""
    value = F.col(column)
    return (F.coalesce(F.lag(value).over(order), value) + 2 * value + F.coalesce(F.lead(value).over(order), value)) / 4


def article_of(blocks: DataFrame) -> DataFrame:
    """``(page_id, html_hash, article, also, but)``: the path of the element that holds each page's
    article, the paths outside it whose blocks belong to it, and those inside it that do not.

    1. Text, punctuation and linked text are summed per page and root-to-leaf tag path, and
       divided by the blocks that have that path.
    2. Both ratios are smoothed over the page's paths in the order in which they begin.
    3. They are fused: text per block, raised by punctuation, lowered by the share of links;
       paths beside the article by their elements' names count for nothing.
    4. Paths from ``THRESHOLD`` of the page's mean are content. The article is the element that
       holds all of them, or the outermost article or main around that, so no content path and no
       title or lead beside the body is left out.
    5. Where no article or main marks its bounds, paths outside that element stay too unless most
       of their text is links, if they are headings, stand as a paragraph right in an element
       around it, or hold a sentence's marks: a low score alone does not drop a title or a last
       short paragraph. Paths inside it that are mostly links go if they stand before or after
       all content.
    """
    page = ["page_id", "html_hash"]
    seen = blocks.select(*page, F.posexplode("blocks").alias("at", "b")).select(*page, "at", "b.path", "b.aside", "b.chars", "b.marks", "b.linked").filter("NOT aside")
    paths = seen.groupBy(*page, "path").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"), F.sum("linked").alias("linked")
    )
    order = W.partitionBy(*page).orderBy("first")
    rated = paths.withColumn("text_ratio", F.col("chars") / F.col("n")).withColumn("mark_ratio", F.col("marks") / F.col("n"))
    smooth = rated.withColumn("text_ratio", _smooth("text_ratio", order)).withColumn("mark_ratio", _smooth("mark_ratio", order))
    fused = smooth.withColumn("score", F.col("text_ratio") * (1 + F.log1p("mark_ratio")) * (1 - F.col("linked") / F.col("chars")))
    whole = W.partitionBy(*page)
    mean = F.sum(F.col("score") * F.col("chars")).over(whole) / F.sum("chars").over(whole)
    steps, last = F.split("path", "/"), F.element_at(F.split("path", "/"), -1)
    above = F.slice(steps, 1, F.size(steps) - 1)
    # The last step of a path is the block itself, unless the text stands right in its container.
    holder = F.when(last.rlike(r"^(article|main|body|html|div|section|td)(\.|$)"), steps).otherwise(above)
    rated = fused.withColumn("mean", mean).withColumn("holder", F.when(F.col("score") >= THRESHOLD * F.col("mean"), holder))
    # What the first and the last of them in order have in common, all have.
    ends = {"low": F.min("holder"), "high": F.max("holder"), "begins": F.min(F.when(F.col("holder").isNotNull(), F.col("first")))}
    ends["stops"] = F.max(F.when(F.col("holder").isNotNull(), F.col("last")))
    held = rated.select("*", *(end.over(whole).alias(name) for name, end in ends.items())).filter("low IS NOT NULL")
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    common = F.slice("low", 1, F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int"))
    marked = F.array_position(F.transform(common, lambda s: s.rlike(r"^(article|main)(\.|$)")), True)
    bounded = marked > 0
    article = F.array_join(F.when(bounded, F.slice(common, 1, marked.cast("int"))).otherwise(common), "/")
    beyond = (F.col("last") < F.col("begins")) | (F.col("first") > F.col("stops"))
    links = ~F.coalesce(bounded, F.lit(False)) & (2 * F.col("linked") >= F.col("chars"))
    placed = held.select(*page, "path", "marks", article.alias("article"), F.coalesce(bounded, F.lit(False)).alias("bounded"), links.alias("links"), (links & beyond).alias("out"))
    sentence = (F.col("marks") > 0) & ~last.rlike(r"^li(\.|$)")
    right_in = last.rlike(r"^(p|blockquote|pre)(\.|$)") & F.startswith(F.concat("article", F.lit("/")), F.concat(F.array_join(above, "/"), F.lit("/")))
    belongs = ~F.col("bounded") & ~F.col("links") & (last.rlike(r"^h[1-6](\.|$)") | sentence | right_in)
    return placed.groupBy(*page).agg(
        F.min("article").alias("article"), F.collect_list(F.when(belongs, F.col("path"))).alias("also"), F.collect_list(F.when(F.col("out"), F.col("path"))).alias("but")
    )


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text.

    The text is every block inside the article's element, and outside it what ``article_of`` adds,
    but not those beside the article by their names, in page order. Blocks are joined by
    line ends; white space within a block, line breaks among it, is one space. Pages are read
    twice, once for their paths and once for their text; the statistics that are shuffled hold
    no text, and a page is at most one row everywhere.

    A name puts an element beside the article if it ends in a word for that (``has-sidebar`` and
    ``related-work`` do not), unless the element holds the article or main, or most of the page's
    text that is no link, or starts with a heading of its id's words. Headings are never judged by
    their id. Words such as ``responses`` count only outside the article, after its last block, or
    where containers of one name repeat in the element.

    Null and empty html, and pages of nothing but boilerplate, give an empty text. Unclosed
    elements, hidden ones among them, end with what holds them, and a hidden one that ends in
    ``/>`` at once; an unfinished tag or comment at the end is markup. Rows
    that repeat a page are alike and returned each; a null page_id is kept; an empty table gives
    an empty result; other columns are not read.
    """
    blocks = blocks_of(pages)
    found = article_of(blocks).select(F.col("page_id").alias("id"), F.col("html_hash").alias("hash"), "article", "also", "but")
    same = F.col("page_id").eqNullSafe(F.col("id")) & F.col("html_hash").eqNullSafe(F.col("hash"))
    kept = blocks.select("page_id", "html_hash", "url", F.filter("blocks", lambda b: ~b["aside"]).alias("blocks")).join(found, same, "left")
    start = F.when(F.col("article") == "", "").otherwise(F.concat("article", F.lit("/")))
    inside = F.filter("blocks", lambda b: F.concat(b["path"], F.lit("/")).startswith(start) & ~F.array_contains("but", b["path"]) | F.array_contains("also", b["path"]))
    text = F.coalesce(F.array_join(F.transform(inside, lambda b: b["text"]), "\n"), F.lit(""))
    return kept.select("page_id", "url", text.alias("text"))


def html_digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
