"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a template. A page is read as tokens: tags under their tag path, and text
nodes as whole strings under theirs. A token's occurrence vector is how often it stands on each page
of its host. Vectors are not held: a vector's fingerprint is the sum, modulo 2^64, of a hash of (page,
count) over the pages, which combines before the shuffle, so a host with a third of all pages is one
row a task and token. Tokens of one fingerprint form an equivalence class. The class whose vector is
one on every page is the template's skeleton; further classes of several tokens that stand once on
nearly all pages are valid on a page if all their tokens lie, in one gap, between the same two tokens
of the skeleton, and are nested there. Exact copies of a page are one page as evidence.

The skeleton's tags part a page into gaps. Over all pages of a host the text in each gap is summed up:
how much there is, in links, in headings, in parts whose names mark them as beside the main text, and in
containers named as the main text. The sums say which gaps are slots of the main text, for the whole
host: those in the named container if the template has one; else all from the first to the last one that
holds a fair share of the host's prose, without those of links, and a heading before them. What a page
has in these slots, without template text, is its main text. Template text is only left out while it is
the lesser part, since pages that share most of their article are copies of it, and headings stay.

A host of too few pages has no template, and a page may have nothing in its host's slots: there the same
signs decide on the page alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, materialise, ship

#: A host's template is deduced from this many pages at least. Optional classes have this many tokens,
#: stand on this share of the pages, and are deduced from this many pages.
LEAST_PAGES, CLASS_TOKENS, OPTIONAL, OPTIONAL_PAGES = 4, 3, 0.9, 10
#: The share of the largest slot's prose that a slot has at least, and of its text that may be marked or in links.
FAIR, MARKED = 0.1, 0.5
#: The share of an article's text nodes that may be template text; beyond, it is what copies share.
WITHIN = 1 / 3
#: Templates are broadcast up to this many tokens, and joined beyond.
BROADCAST_TOKENS = 2_000_000
SALTS = 64

# fixed values: elements without content of their own
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: elements whose content is never main text
DROPPED = frozenset("head script style noscript template svg iframe object canvas audio video map nav footer aside form menu dialog button select textarea datalist option label fieldset title".split())
# fixed values: elements that begin and end a block
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: words of class, id or role that name parts beside the main text
BESIDE = frozenset(
    "nav navbar navigation menu menubar sidebar side aside masthead topbar footer bottombar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs"
    " newsletter subscribe subscription signup login pagination pager paging widget widgets toolbar skip search complementary contentinfo".split()
)
# fixed values: names of parts that are beside the main text unless they are inside it
OUTER = frozenset(("header",))
# fixed values: names of containers of the main text
MAIN = frozenset("article main content post entry story".split())
# fixed values: elements whose open one ends when another of the kind opens
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_OPEN = re.compile(r"<(/?)([a-z][^\s/>]*)([^<>\"']*)>", re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_PLAIN = re.compile(r"[^>\"']*")
_RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names_of(attributes: str) -> frozenset[str]:
    """The words in class, id and role."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(w.lower() for m in _NAMED.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or ""))


def _tags(source: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text) and (slash, name, attributes) in order. Every character is read a bounded number of
    times: a quote that is never closed is looked for once, and once a tag has not ended outside quotes,
    tags end at their first ``>``."""
    pos, n, last = 0, len(source), source.rfind(">")
    unclosed: dict[str, bool] = {}
    strict = True

    def end_of(at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, outside quotes if it does."""
        nonlocal strict
        i = at
        while strict:
            i = _PLAIN.match(source, i).end()
            if i >= n:
                strict = False
            elif source[i] == ">":
                return i
            elif unclosed.get(source[i]):
                i += 1
            elif (close := source.find(source[i], i + 1)) < 0:
                unclosed[source[i]] = True
                i += 1
            else:
                i = close + 1
        return source.find(">", at)

    while pos < n:
        at = source.find("<", pos)
        if at < 0 or at > last:
            yield "", "", source[pos:]
            return
        if at > pos:
            yield "", "", source[pos:at]
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            if end < 0:
                return
            pos = end + 3
        elif m := _OPEN.match(source, at):
            yield m[1], m[2].lower(), m[3]
            pos = m.end()
        elif m := _NAME.match(source, at):
            end = end_of(m.end())
            yield m[1], m[2].lower(), source[m.end() : end]
            pos = end + 1
        elif source.startswith(("<!", "<?"), at):
            pos = source.find(">", at) + 1
        else:
            yield "", "", "<"
            pos = at + 1
            continue
        if m and not m[1] and (raw := _RAW_END.get(m[2].lower())):  # its content is no text
            end = raw.search(source, pos)
            pos = end.end() if end else n


@dataclass
class Node:
    """A text node: how many tokens stand before it, its token's place (-1 for white space), its block,
    text, whether it is marked as beside the main text, the rank of its container, in a link or heading
    or paragraph."""

    at: int
    token: int
    block: int
    text: str
    beside: bool
    rank: int
    link: bool
    heading: bool
    para: bool


@dataclass
class Page:
    """Tokens of a page in order, and its text nodes."""

    tokens: list[int] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


def read(source: str) -> Page:
    """Tokens and text nodes of a page, in one pass that never fails on malformed markup."""
    page = Page()
    # name, path hash, beside, rank of main container, link, heading, paragraph
    stack: list[tuple[str, int, bool, int, bool, bool, bool]] = []
    top = ("", 0, False, 0, False, False, False)
    block, tokens, nodes, opened = 0, page.tokens, page.nodes, Counter()
    mix = lambda a, b: xxhash.xxh64_intdigest(b, seed=a & 0xFFFFFFFFFFFFFFFF)

    def pop(to: int) -> None:
        nonlocal top
        opened.subtract(x[0] for x in stack[to:])
        del stack[to:]
        top = stack[-1] if stack else ("", 0, False, 0, False, False, False)

    for slash, name, rest in _tags(source):
        _, path, beside, rank, link, heading, para = top
        if not name:
            s = html.unescape(rest) if "&" in rest else rest
            if s and not s.isspace():
                tokens.append(mix(path, " ".join(s.split())))
                nodes.append(Node(len(tokens) - 1, len(tokens) - 1, block, s, beside, rank, link, heading, para))
            elif s:
                nodes.append(Node(len(tokens), -1, block, s, beside, rank, link, heading, para))
            continue
        if name in BLOCKS:
            block += 1
        if slash:
            for i in range(len(stack) - 1, -1, -1) if opened[name] > 0 else ():
                if stack[i][0] == name:
                    tokens.append(mix(stack[i][1], "/"))
                    pop(i)
                    break
            continue
        if name in VOID:
            tokens.append(mix(path, name))
            if name == "br":
                nodes.append(Node(len(tokens), -1, block, " ", beside, rank, link, heading, para))
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[i][0] in CLOSES[name]:
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name in BLOCKS and any(x[0] == "p" for x in stack[-3:]):  # a block ends an open paragraph
            pop(max(i for i, x in enumerate(stack) if x[0] == "p"))
        _, path, beside, rank, link, heading, para = top
        words = names_of(rest)
        path = mix(path, name + " " + " ".join(sorted(words)))
        if name in DROPPED or (words & BESIDE and name not in ("html", "body", "article", "main")):
            beside = True
        elif name == "header" or words & OUTER and name not in ("html", "body", "article", "main"):  # one inside the main text has its heading
            beside = beside or not rank
        elif name in ("article", "main") or "main" in words and "role" in rest.lower():
            rank = 2
        elif words & MAIN and name in ("div", "section", "td"):
            rank = max(rank, 1)
        top = (name, path, beside, rank, link or name == "a", heading or name in HEADINGS, para or name == "p")
        stack.append(top)
        opened[name] += 1
        tokens.append(path)
        if rest.endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "em", "strong", "span"):
            pop(len(stack) - 1)
    return page


@dataclass(frozen=True)
class Template:
    """Token classes of a host: the skeleton, optional classes, and the tags before gaps of main text."""

    skeleton: frozenset[int] = frozenset()
    optional: tuple[frozenset[int], ...] = ()
    slots: frozenset[int] = frozenset()

    def on(self, page: Page) -> frozenset[int]:
        """The template's tokens on a page: the skeleton and the classes that are valid there."""
        if not self.skeleton or not self.optional:
            return self.skeleton
        gap, gaps = 0, defaultdict(list)
        for t in page.tokens:
            gap += t in self.skeleton
            gaps[t].append(gap)
        held = set(self.skeleton)
        for c in self.optional:
            if all(len(gaps[t]) == 1 for t in c if t in gaps) and c <= gaps.keys() and len({gaps[t][0] for t in c}) == 1:
                held |= c
        return frozenset(held)

    def gaps(self, page: Page) -> list[tuple[int, int]]:
        """For each text node the skeleton's last tag before it, and how many came before (0 at the start)."""
        text = {n.token for n in page.nodes if n.token >= 0}
        out, at, gap, order = [], 0, 0, 0
        for n in page.nodes:
            for i in range(at, n.at):
                if page.tokens[i] in self.skeleton and i not in text:
                    gap, order = page.tokens[i], order + 1
            at = max(at, n.at)
            out.append((gap, order))
        return out


#: What is summed up in each gap of a host: pages, the gap's place, characters of slot text, of all text,
#: in links, in headings, marked as beside, in containers of either rank.
SUMS = ("pages", "place", "own", "every", "link", "heading", "beside", "rank1", "rank2")


def gap_sums(page: Page, template: Template) -> dict[int, list[int]]:
    """SUMS of the gaps of one page, by the tag before each."""
    known, out = template.on(page), {}
    for n, (gap, order) in zip(page.nodes, template.gaps(page)):
        if n.token < 0:
            continue
        k = len(n.text.strip())
        row = out.get(gap)
        if row is None:
            row = out[gap] = [1, order, 0, 0, 0, 0, 0, 0, 0]
        for i, hit in enumerate((page.tokens[n.token] not in known, True, n.link, n.heading, n.beside, n.rank == 1, n.rank == 2)):
            row[i + 2] += k * hit
    return out


def choose(gaps: dict[int, list[int]]) -> frozenset[int]:
    """The gaps of a host that are slots of its main text, from SUMS by gap."""
    col = {c: i for i, c in enumerate(SUMS)}
    of = lambda g, c: gaps[g][col[c]]
    left = [g for g in gaps if of(g, "beside") <= MARKED * of(g, "every")]
    for rank in ("rank2", "rank1"):
        if held := [g for g in left if of(g, rank) > MARKED * of(g, "every")]:
            return frozenset(held)
    # without named containers: prose, which copies of one article have as template text
    own = "own" if sum(of(g, "own") for g in left) > FAIR * sum(of(g, "every") for g in left) else "every"
    left = sorted((g for g in left if of(g, "link") <= MARKED * of(g, "every")), key=lambda g: (of(g, "place") / of(g, "pages"), g))
    most = max((of(g, own) for g in left), default=0)
    fair = [i for i, g in enumerate(left) if of(g, own) > 0 and of(g, own) >= FAIR * most]
    if not fair:
        return frozenset()
    first = fair[0]
    while first and of(left[first - 1], own) and of(left[first - 1], "heading") > MARKED * of(left[first - 1], "every"):
        first -= 1
    return frozenset(left[first : fair[-1] + 1])


def text_of(page: Page, template: Template = Template()) -> str:
    """The main text: blocks of slot text joined by line feeds."""
    nodes, slots = [n for n in page.nodes if not n.beside], False
    if template.slots:
        held = [n for n, (gap, _) in zip(page.nodes, template.gaps(page)) if gap in template.slots and not n.beside]
        if slots := any(n.token >= 0 for n in held):
            nodes = held
    if not slots:
        rank = max((n.rank for n in nodes if n.token >= 0), default=0)
        nodes = [n for n in nodes if n.rank == rank]
        slots = rank > 0
    known = template.on(page)
    if known:
        left = [n for n in nodes if n.token < 0 or page.tokens[n.token] not in known or slots and n.heading]
        texts, kept = (sum(n.token >= 0 and not (slots and n.heading) for n in x) for x in (nodes, left))
        if any(n.token >= 0 for n in left) and (not slots or texts - kept <= WITHIN * texts):
            nodes = left
    out: list[str] = []
    at, held, linked, whole = None, [], 0, False

    def flush() -> None:
        s = " ".join("".join(held).split())
        # outside any slot, a block that is mostly links and no paragraph or heading is a menu
        if s and (slots or whole or 2 * linked <= len(s)):
            out.append(s)

    for n in nodes:
        if n.block != at:
            flush()
            at, held, linked, whole = n.block, [], 0, False
        held.append(n.text)
        linked += len(n.text.strip()) * n.link
        whole = whole or n.para or n.heading
    flush()
    return "\n".join(out)


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host``, lower-cased, empty where the url has none."""
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def templates(pages: DataFrame) -> DataFrame:
    """(host, kind, tokens): one row per class of each host's template, the skeleton or optional. Hosts of
    fewer than ``LEAST_PAGES`` different pages have none. ``pages`` has host and html."""
    ship(pages.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            hosts: Counter[tuple[str, int]] = Counter()
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                source = source or ""
                page = xxhash.xxh64_intdigest(source)
                hosts[host, page] += 1
                tokens = read(source).tokens
                counts = Counter(tokens)
                for token, n in counts.items():
                    row = seen.get((host, token))
                    if row is None:
                        row = seen[host, token] = [0, 0, 0]
                    row[0] += 1
                    row[1] += n
                    row[2] = (row[2] + (page ^ n) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            names = [h for h, _ in seen] + [h for h, _ in hosts]
            tokens = np.fromiter((t for _, t in seen), dtype=np.uint64, count=len(seen))
            rows = np.array(list(seen.values()), dtype=np.uint64).reshape(-1, 3)
            pad = len(hosts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate((_signed(tokens), _signed(np.fromiter((p for _, p in hosts), dtype=np.uint64, count=pad))))),
                    pa.array(np.concatenate((_signed(rows[:, 0]), np.fromiter(hosts.values(), dtype=np.int64, count=pad)))),
                    pa.array(np.concatenate((_signed(rows[:, 1]), np.full(pad, -1, dtype=np.int64)))),
                    pa.array(np.concatenate((_signed(rows[:, 2]), np.zeros(pad, dtype=np.int64)))),
                ],
                ["host", "token", "pages", "times", "vector"],
            )

    # times is negative in the rows that count a host's pages, by their hash; sums of vectors wrap, as 64 bits do
    rows = pages.select("host", "html").mapInArrow(lean(gather), "host string, token long, pages long, times long, vector long")
    split = rows.select("host", "token", "pages", "times", (F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.shiftrightunsigned("vector", 32).alias("high"))
    size = F.col("times") < 0
    found = split.groupBy("host", size.alias("size"), "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "low", "high")))
    found = materialise(found, "tokens")
    hosts = found.where("size").groupBy("host").agg(F.sum("pages").alias("n"), F.count("*").alias("distinct")).where(F.col("distinct") >= LEAST_PAGES)
    vector = (F.col("low") + F.shiftleft(F.col("high") + F.shiftright("low", 32), 32)).alias("vector")
    # once on each page that has it, and on enough pages: a page's length over OPTIONAL bounds a host's rows
    once = found.where("not size and pages = times").join(F.broadcast(hosts) if hosts.count() <= BROADCAST_TOKENS else hosts, "host").where(F.col("pages") >= OPTIONAL * F.col("n"))
    classes = once.select("host", "token", "pages", "n", "distinct", vector).groupBy("host", "vector").agg(F.collect_list("token").alias("tokens"), F.max("pages").alias("pages"), F.max("n").alias("n"), F.max("distinct").alias("distinct"))
    whole = F.col("pages") == F.col("n")
    return classes.where(whole | ((F.size("tokens") >= CLASS_TOKENS) & (F.col("distinct") >= OPTIONAL_PAGES))).select("host", F.when(whole, SKELETON).otherwise(F.lit(OPTIONAL_CLASS)).alias("kind"), "tokens")


#: Kinds of a template's rows.
SKELETON, OPTIONAL_CLASS, SLOTS = 0, 1, 2


def _template(rows: list) -> Template:
    u = lambda tokens: frozenset(t & 0xFFFFFFFFFFFFFFFF for t in tokens)
    of = lambda kind: [u(r["tokens"]) for r in rows if r["kind"] == kind]
    return Template(frozenset().union(*of(SKELETON)), tuple(of(OPTIONAL_CLASS)), frozenset().union(*of(SLOTS)))


def with_templates(pages: DataFrame, found: DataFrame, kernel, names: list[str], schema: str) -> DataFrame:
    """``kernel(batch of names, templates)`` over all pages: templates are broadcast up to
    ``BROADCAST_TOKENS`` tokens, and joined beyond."""
    spark = pages.sparkSession
    n = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if n <= BROADCAST_TOKENS:
        rows: dict[str, list] = defaultdict(list)
        for r in found.toLocalIterator() if n else ():
            rows[r.host].append(r)
        sent = spark.sparkContext.broadcast({host: _template(r) for host, r in rows.items()})
        host_at = names.index("host")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield kernel(b, [sent.value.get(host, Template()) for host in b.column(host_at).to_pylist()])

        return pages.select(*names).mapInArrow(lean(run), schema)

    # hot hosts are dealt over SALTS tasks; each salt has a copy of the host's template
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("url", F.xxhash64("html")), F.lit(SALTS)))
    copies = found.groupBy("host").agg(F.collect_list(F.struct("kind", "tokens")).alias("classes")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(copies, ["host", "salt"], "left").select(*names, "classes")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield kernel(b, [_template(c or []) for c in b.column(len(names)).to_pylist()])

    return joined.mapInArrow(lean(run_joined), schema)


def slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, kind, tokens): for each host with a template the tags before the gaps of its main text."""

    def sums(b: pa.RecordBatch, templates: list[Template]) -> pa.RecordBatch:
        total: dict[tuple[str, int], list[int]] = {}
        for host, source, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), templates):
            if t.skeleton:
                for gap, row in gap_sums(read(source or ""), t).items():
                    old = total.get((host, gap))
                    total[host, gap] = [x + y for x, y in zip(old, row)] if old else row
        cols = list(zip(*total.values())) or [()] * len(SUMS)
        gaps = _signed(np.fromiter((g for _, g in total), dtype=np.uint64, count=len(total)))
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array(gaps), *(pa.array(c, pa.int64()) for c in cols)], ["host", "gap", *SUMS])

    rows = with_templates(pages, found, sums, ["host", "html", "url"], "host string, gap long, " + ", ".join(f"{c} long" for c in SUMS))
    rows = rows.groupBy("host", "gap").agg(*(F.sum(c).alias(c) for c in SUMS))
    # a page's tags bound a host's gaps
    gathered = rows.groupBy("host").agg(F.collect_list(F.array("gap", *SUMS)).alias("gaps"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(choose({g[0]: g[1:] for g in own})) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([SLOTS] * len(got), pa.int32()), pa.array(got, pa.list_(pa.int64()))], ["host", "kind", "tokens"])

    return gathered.mapInArrow(lean(pick), "host string, kind int, tokens array<long>")


def extract(pages: DataFrame, use_templates: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, one row per input row.

    ``text`` is the main text, blocks joined by line feeds, white space inside a block as one space;
    empty if the html is null, empty or has none. Pages with a null or odd url share the empty host.
    Repeated rows stay repeated; other columns are ignored; malformed markup gives what can be read; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = with_host(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))

    def main_text(b: pa.RecordBatch, templates: list[Template]) -> pa.RecordBatch:
        texts = [text_of(read(h or ""), t) for h, t in zip(b.column(2).to_pylist(), templates)]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if use_templates:
        found = materialise(templates(pages), "templates")
        found = found.unionByName(materialise(slots(pages, found), "slots"))
    else:
        found = spark.createDataFrame([], "host string, kind int, tokens array<long>")
    return with_templates(pages, found, main_text, ["page_id", "url", "html", "host"], "page_id long, url string, text string, n_chars long")
