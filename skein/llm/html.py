"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path of tags and classes, and its text blocks. The pages of a host
with a main container and those without one are two layouts. Over the pages of one layout a token has an occurrence
vector: how often each page holds it, where pages with the same html are one. Tokens
with one vector form an equivalence class. The vectors are never gathered: a token's vector is known by its
sums of count * hash(page) under two hashes, which one aggregation makes for all hosts. Classes with enough
members and pages whose elements hang below one other class at most are valid and nest into the layout's template, whose
root is the class of what every page holds once. Text in the template is furniture. What remains are the slots: a slot is a
template element with all that hangs below it and below no other template element, and what the layout's pages have there (characters, those inside links, blocks) is
known from the same aggregation.

The layout's slots then are judged together, once for all its pages. Elements that serve navigation, forms and
asides by their tag are no article. Names of classes are a weaker sign: they count on grouping elements only, not on headings, paragraphs or
an ``article`` itself, and not on an element that holds the larger part of the layout's text. Slots with most of
their text inside links are menus, unless they lie in the main container. The main container is what is named so, if it
holds a good part of the text, and else the whole page. A block of a page is taken if the slot that it falls into is the article's and its text is
no furniture; without a template nothing would be. A page whose main text is furniture throughout is one of several that say the same, and keeps it.

Cases. Null html: empty text. Null or odd url: such pages form a host of their own. Hosts of one or few pages have a template as well; only that
text is furniture needs ``MIN_PAGES`` pages (``MAIN_PAGES`` inside a main container). Broken markup: open elements
end where HTML ends them, unclosed comments and scripts at the end of the page. Repeated rows: rows of their own, with one page's weight in the template.
Very long pages are read whole, in time linear in their length. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from decimal import Decimal

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialise, need, read, row_pass, spread

#: Pages of a layout, copies counted once, that must hold a text before it is furniture, and the same inside a main container, whose name speaks for its text.
MIN_PAGES = 3
MAIN_PAGES = 10
#: Share of a layout's pages that a token must be on to be of its template.
MIN_SHARE = 0.1
#: Members of a valid class.
MIN_MEMBERS = 2
#: A slot with more than this share of its text inside links is a menu.
LINK_SHARE = 0.5
#: An element with this share of its layout's text is no furniture whatever its name.
MOST = 0.5
#: Named containers are the main ones if they hold this share of their layout's text.
MAIN_SHARE = 0.25

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|canvas|audio|video)\b(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|</?[a-z][^<>]*>|<[!?][^<>]*>",
    re.S | re.I,
)
#: The end of a tag that closes itself: a slash that isn't the last character of a value without quotes.
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_NAME = re.compile(r"""(?:\s|/|^)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Elements of HTML by their behaviour.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
#: Elements that never hold the article, and the words of classes, ids and roles that say the same of grouping elements.
_APART = frozenset("head nav footer aside form dialog menu fieldset title".split())
_GROUPING = frozenset("div section ul ol dl table tbody tr td details figure header span center main body".split())
_APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs footer header masthead sidebar aside widget widgets comment comments reply replies respond disqus cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations toolbar pagination pager skip search form complementary contentinfo dialog".split()
)
_MAIN_WORDS = frozenset({"main", "article"})


def _class_words(attrs: str) -> list[str]:
    words: list[str] = []
    for m in _NAME.finditer(attrs):
        # camelCase and separators part words
        words += re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", m[2])
    return [w.lower() for w in words]


class _Open:
    """An open element. apart: by its tag or attributes, or those above; named: by its own name; near: the element whose block its text is."""

    __slots__ = ("apart", "main", "named", "near", "path", "tag")

    def __init__(self, tag: str, path: int, apart: bool, main: bool, named: bool, above: _Open | None) -> None:
        self.tag, self.path, self.apart, self.main, self.named = tag, path, apart, main, named
        self.near = self if above is None or tag in _BLOCK or (apart and not above.apart) else above.near


_ROOT = _Open("", 1, False, False, False, None)


def _child(top: _Open, tag: str, attrs: str, memo: dict) -> _Open:
    key = (top.path, tag, attrs, top.apart, top.main)
    found = memo.get(key)
    if found is None:
        words = _class_words(attrs) if attrs else []
        says = any(w in _APART_WORDS for w in words)
        apart = top.apart or tag in _APART or bool(attrs and _HIDDEN.search(attrs)) or (tag == "header" and not top.main)
        named = says and tag in _GROUPING and not (tag == "header" and top.main and not any(w in _APART_WORDS - {"header"} for w in words))
        main = top.main or (not apart and (tag in ("article", "main") or (tag in _GROUPING - {"body"} and any(w in _MAIN_WORDS for w in words) and not says)))
        label = f"{top.path}>{tag}.{'.'.join(sorted(set(words)))}.{apart:d}"
        path = xxhash.xxh64_intdigest(label.encode()) >> 1
        if len(memo) > 200_000:
            memo.clear()
        found = memo[key] = _Open(tag, path, apart, main, named, top)
    return found


class _Stack:
    """The open elements, and where in the stack the elements of each tag are."""

    def __init__(self) -> None:
        self.open, self.at, self.links = [_ROOT], {}, 0

    def push(self, o: _Open) -> None:
        self.at.setdefault(o.tag, []).append(len(self.open))
        self.open.append(o)
        self.links += o.tag == "a"

    def cut(self, k: int) -> bool:
        """Close all elements from the k-th on; whether the last one closed ended a part of the page that stands apart."""
        below = self.open[k].apart and not self.open[k - 1].apart
        for o in reversed(self.open[k:]):
            self.at[o.tag].pop()
            self.links -= o.tag == "a"
        del self.open[k:]
        return below

    def last(self, tags) -> int:
        """Where the innermost open element of one of the tags is, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def parse(page: str, memo: dict) -> tuple[dict[int, int], dict[int, tuple[int, bool, bool, bool]], list[tuple[int, bool, bool, str, int]]]:
    """Elements of a page by path with their counts; of each path its parent, whether apart, main and named; and its text blocks.

    A block: the path of its element, apart, main, text with decoded references and single spaces, characters of it inside links.
    """
    counts: dict[int, int] = {}
    about: dict[int, tuple[int, bool, bool, bool]] = {}
    blocks: list[tuple[int, bool, bool, str, int]] = []
    stack, piece, linked, at, pos = _Stack(), [], 0, _ROOT, 0

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                blocks.append((at.path, at.apart, at.main, text, min(linked, len(text))))
            piece.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal at, linked
        top = stack.open[-1]
        if not piece:
            at = top.near  # a block belongs to its nearest block element
        elif top.apart != at.apart:
            flush()
            at = top.near
        text = entities.unescape(text) if "&" in text else text
        piece.append(text)
        if stack.links:
            linked += len(text.strip())

    for m in _TAG.finditer(page):
        if m.start() > pos:
            put(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        if m["end"]:
            if stack.at.get(tag):
                k = stack.at[tag][-1]
                if stack.open[-1].apart != stack.open[k - 1].apart:
                    flush()
                stack.cut(k)
            continue
        if tag in _BLOCK and tag != "br":
            k = stack.last(("p",))
            if k > stack.last(("button", "table", "td", "th", "caption")):
                stack.cut(k)
        if tag in _ENDS:
            ends, until = _ENDS[tag]
            k = stack.last(ends)
            if k > stack.last(until):
                # the outermost one of those that end, above what bounds them
                bound = stack.last(until)
                stack.cut(min(p for t in ends for p in stack.at.get(t, ())[-1:] if p > bound))
        top = stack.open[-1]
        here = _child(top, tag, m["attrs"] if "=" in m["attrs"] or "hidden" in m["attrs"] else "", memo)
        if here.path not in counts:
            counts[here.path] = 0
            about[here.path] = (top.path, here.apart, here.main, here.named)
        counts[here.path] += 1
        if tag not in _VOID and not _CLOSED.search(m["attrs"]):
            if here.apart != top.apart:
                flush()
            stack.push(here)
    if pos < len(page):
        put(page[pos:])
    flush()
    return counts, about, blocks


def holds_main(blocks: list[tuple[int, bool, bool, str, int]]) -> bool:
    """Whether a page has text in a main container."""
    return any(b[2] and not b[1] for b in blocks)


def _text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}|{text}".encode("utf-8", "surrogatepass"), 7) >> 1


_TOKEN = (
    "host:string,in_main:boolean,token:bigint,page:bigint,parent:bigint,is_text:boolean,apart:boolean,main:boolean,named:boolean,"
    "pages:bigint,total:bigint,sum1:decimal(38,0),sum2:decimal(38,0),chars:bigint,linked:bigint"
)


def page_tokens(pages: DataFrame) -> DataFrame:
    """Partial sums of the tokens of each host and layout, one row for each part of a batch and token. pages: key, host, html, copied.

    page is null but for pages that have copies, whose tokens have rows of their own, so that copies can be told from pages of their own.

    chars and linked of an element are those of all text below it that doesn't stand apart. A text that one page of the part holds
    is left to the other parts to repeat: it comes along as well, as they may.
    """

    def maker():
        memo: dict = {}

        def make(keys, hosts, texts, copied):
            sums: dict[tuple, list] = {}
            done = set()
            for key, host, page, again in zip(keys, hosts, texts, copied, strict=True):
                own = key if again else None
                if again and (host, key) in done:
                    continue
                done.add((host, key))
                counts, about, blocks = parse(page or "", memo)
                h1, h2 = key & 0x7FFFFFFF, (key >> 31) & 0x7FFFFFFF
                seen = {(p, False): [n, *about[p], 0, 0] for p, n in counts.items()}
                seen[(1, False)] = [1, 0, False, False, False, 0, 0]  # the page itself
                texts_of = []
                for path, apart, main, text, linked in blocks:
                    if not apart:
                        slot = seen[(path, False)]
                        slot[5] += len(text)
                        slot[6] += linked
                        texts_of.append(((_text_token(path, text), True), [0, path, apart, main, False, 0, 0]))
                for path in reversed(about):  # a path comes after its parent
                    up, below = seen[(about[path][0], False)], seen[(path, False)]
                    up[5] += below[5]
                    up[6] += below[6]
                for token, new in texts_of:
                    seen.setdefault(token, new)[0] += 1
                layout = (host, holds_main(blocks))
                for (token, is_text), (n, parent, apart, main, named, chars, linked) in seen.items():
                    s = sums.setdefault((*layout, token, is_text, own), [parent, apart, main, named, 0, 0, 0, 0, 0, 0])
                    for k, v in enumerate((1, n, n * h1, n * h2, chars, linked), 4):
                        s[k] += v
            rows = [
                {"host": h, "in_main": i, "token": t, "page": g, "parent": s[0], "is_text": x, "apart": s[1], "main": s[2], "named": s[3],
                 "pages": s[4], "total": s[5], "sum1": Decimal(s[6]), "sum2": Decimal(s[7]), "chars": s[8], "linked": s[9]}
                for (h, i, t, x, g), s in sums.items()
            ]
            return [[rows] + [[]] * (len(keys) - 1)]

        return make

    return row_pass(pages, ["key", "host", "html", "copied"], f"tokens array<struct<{_TOKEN}>>", maker, []).select(F.inline("tokens"))


def template_tokens(pages: DataFrame, min_share: float = MIN_SHARE, min_members: int = MIN_MEMBERS) -> DataFrame:
    """The frequent tokens of each host and layout with the number of its pages (``of``) and whether they are of its template (``valid``)."""
    layout = ["host", "in_main"]
    token, about, counted = [*layout, "token", "is_text"], ("parent", "apart", "main", "named"), ("pages", "total", "sum1", "sum2", "chars", "linked")
    first = [F.first(c).alias(c) for c in about]
    # one page of copies counts; both groupings share one exchange
    sums = (
        page_tokens(pages).repartition(*token)
        .groupBy(*token, "page").agg(*first, *(F.when(F.col("page").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c) for c in counted))
        .groupBy(*token).agg(*first, *(F.sum(c).alias(c) for c in counted))
        .where("not is_text or pages >= 2").withColumn("class", F.xxhash64("pages", "total", "sum1", "sum2"))
    )
    sums = materialise(sums, "tokens")
    hosts = sums.where("token = 1 and not is_text").select(*layout, F.col("pages").alias("of"), F.col("class").alias("root"))
    often = materialise(sums.join(hosts, layout).where(F.col("pages") >= F.col("of") * min_share), "frequent")
    above = often.where("not is_text").select(*layout, F.col("token").alias("parent"), F.col("class").alias("above"))
    classes = (
        often.join(above, [*layout, "parent"], "left").groupBy(*layout, "class", "root")
        .agg(F.count("*").alias("members"), F.count_if(~F.col("is_text")).alias("elements"),
             F.count_distinct(F.when(~F.col("is_text") & (F.col("above") != F.col("class")), F.col("above"))).alias("parents"))
    )
    nested = (F.col("members") >= min_members) & (F.col("elements") >= 1) & (F.col("parents") <= 1)
    valid = classes.where(nested | (F.col("class") == F.col("root"))).select(*layout, "class", F.lit(True).alias("valid"))
    return often.join(valid, [*layout, "class"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def judged(elements: list[dict]) -> tuple[list[int], list[int]]:
    """(taken, left): the elements of a layout whose slot, and all below up to the next judged element, is the article's or isn't.

    elements: token, parent, apart, main, named, valid, chars, linked of the layout's frequent elements; those that aren't of the template only
    hand down what is above them.
    """
    of = {e["token"]: e for e in elements}
    depth: dict[int, int] = {1: 0}
    for e in elements:
        way, t = [], e["token"]
        while t not in depth and t in of:
            way.append(t)
            t = of[t]["parent"]
        for t in reversed(way):
            depth[t] = depth.get(of[t]["parent"], 0) + 1
    order = sorted(of, key=lambda t: (depth[t], t))  # parents first
    whole = max((e["chars"] for e in elements), default=0)
    apart: dict[int, bool] = {}
    good = {t: of[t]["chars"] for t in order}
    for t in order:
        e = of[t]
        named = e["named"] and (e["valid"] or not e["main"]) and e["chars"] < MOST * whole
        apart[t] = apart.get(e["parent"], False) or e["apart"] or named
    less = dict.fromkeys(of, 0)
    for t in reversed(order):  # text that stands apart is none of those above
        up = of[t]["parent"]
        if up in of:
            less[up] += of[t]["chars"] if apart[t] and not apart[up] else less[t]
    good = {t: good[t] - less[t] for t in order}
    mains = [t for t in order if of[t]["main"] and not apart[t] and not of.get(of[t]["parent"], {"main": False})["main"]]
    inside = sum(good[t] for t in mains) >= MAIN_SHARE * max(1, good.get(1, 0)) and any(good[t] for t in mains)
    taken, left, state = [], [], {}
    for t in order:
        e = of[t]
        menu = e["linked"] > LINK_SHARE * e["chars"] and not e["main"]
        state[t] = not apart[t] and not menu and (e["main"] if inside else True)
        # an element that is not of the template is no slot of its own, but one that stands apart or is a menu is left wherever it is
        if t == 1 or e["valid"] or not state[t]:
            (taken if state[t] else left).append(t)
    return taken, left


def templates(pages: DataFrame, min_share: float = MIN_SHARE, min_members: int = MIN_MEMBERS, min_pages: int = MIN_PAGES, main_pages: int = MAIN_PAGES) -> DataFrame:
    """t_host and for both layouts of each host (plain and main) the struct taken, left (elements) and furniture (text tokens).

    Only tokens on ``min_share`` of a layout's pages are kept, so a layout has at most 1 / min_share times the tokens of
    a page, whatever the number of its pages: its elements are judged together in one row.
    """
    tokens = materialise(template_tokens(pages, min_share, min_members), "template-tokens")
    about = F.struct(*(F.col(c) for c in ("token", "parent", "apart", "main", "named", "valid", "chars", "linked")))
    enough = F.col("pages") >= F.greatest(F.lit(2), F.when(F.col("in_main"), main_pages).otherwise(min_pages), 0.5 * F.col("of"))
    rows = tokens.groupBy("host", "in_main").agg(
        F.collect_list(F.when(~F.col("is_text"), about)).alias("elements"), F.collect_set(F.when(F.col("is_text") & F.col("valid") & enough, F.col("token"))).alias("furniture")
    )

    def maker():
        def make(elements):
            found = [judged(e) for e in elements]
            return [f[0] for f in found], [f[1] for f in found]

        return make

    slots = row_pass(rows, ["elements"], "taken array<long>, left array<long>", maker, ["host", "in_main", "furniture"])
    of = F.struct("taken", "left", "furniture")
    return slots.groupBy("host").agg(F.max(F.when(~F.col("in_main"), of)).alias("plain"), F.max(F.when(F.col("in_main"), of)).alias("main")).withColumnRenamed("host", "t_host")


def extract(about: dict[int, tuple[int, bool, bool, bool]], blocks: list[tuple[int, bool, bool, str, int]], plain: dict | None, main: dict | None) -> str:
    """Text of a page's article slots. about, blocks: from ``parse``."""
    layout = main if holds_main(blocks) else plain
    if layout is None:
        return ""
    known, furniture = layout["known"], layout["fixed"]
    taken = {1: known.get(1, False)}
    for path, (up, *_) in about.items():  # a path comes after its parent
        taken[path] = known.get(path, taken[up])
    data = [(path, text) for path, apart, _, text, _ in blocks if not apart and taken[path]]
    kept = [text for path, text in data if _text_token(path, text) not in furniture]
    if not kept:
        kept = [text for _, text in data]  # pages that say the same are no template of each other
    return " ".join(kept)


def _known(layout: dict | None, other: dict | None) -> dict | None:
    if layout is None:
        return None
    known = dict.fromkeys(layout["left"], False) | dict.fromkeys(layout["taken"], True)
    # what stands outside the container of one layout may stand in the other
    return {"known": known, "fixed": frozenset(layout["furniture"]) | frozenset(other["furniture"] if other else ())}


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    base = need(pages, page_id=T.LongType(), url=T.StringType(), html=T.StringType())
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    base = base.withColumn("host", host)
    key = F.xxhash64(F.coalesce("html", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = base.select(key.alias("key"), "host", "html")
    copies = materialise(keyed.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").select("host", "key", F.lit(True).alias("copied")), "copies")
    found = materialise(templates(keyed.join(copies, ["host", "key"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))), "templates")

    def maker():
        memo: dict = {}
        last: list = [None, None, None, None]

        def one(page, plain, main):
            if last[:2] != [plain, main]:  # pages of one host often follow each other
                last[:] = [plain, main, _known(plain, main), _known(main, plain)]
            return extract(*parse(page, memo)[1:], *last[2:]) if page else ""

        def make(htmls, plains, mains):
            texts = [one(*x) for x in zip(htmls, plains, mains, strict=True)]
            return texts, [len(t) for t in texts]

        return make

    joined = base.join(found, F.col("host") == F.col("t_host"), "left").select("page_id", "url", "html", "plain", "main")
    return row_pass(joined, ["html", "plain", "main"], "text string, n_chars long", maker, ["page_id", "url"])


def op1_template_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spread(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
