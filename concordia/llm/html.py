"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its markup tokens and its text blocks, each told apart by its role: the path of the
elements around it.  Within a host, a token's occurrence vector says how often each page has it; tokens with equal
vectors form an equivalence class (Arasu and Garcia-Molina 2003).  A vector is compared by the xor of hashes of
its (page, count) pairs, so it is aggregated like a sum and no host's pages ever meet in one task; pages with one
and the same article count once, so that copies of an article are not taken for a template.

A class is a candidate if it has LEAST_SUPPORT pages and LEAST_SIZE tokens at least (the method's two thresholds),
a markup token among them: texts that only go together with each other are what near-copies of an article
share, not a template.  It is valid if it is ordered (on every page its tokens come in one and the same order, as
often as its count says) and nested: on every page its occurrences lie whole inside one and the same slot of the class
around them, and overlap none; of two classes that do, the one on more pages stays, then the one that occurs less often,
then the larger.  Valid classes are the host's template: their text blocks are boilerplate, whatever
share of the pages has them, and what lies between their tokens are slots.  After an occurrence of an inner class
ends, the slot around it goes on.

What remains in the slots is extracted, less what the enclosing elements say is a menu, header, footer, sidebar,
notice, advert, form or reader comment (element names and roles; where these say nothing, WORDS in class or id names).
Where a page marks its article, only blocks inside it count; on other pages, slots that are mostly link text go.

Defined results: null or empty html gives an empty text; a null or unusable url is a host of its own
without a template, as is a host with fewer than LEAST_SUPPORT different articles; broken or cut off markup is read as
far as it goes; pages of any length are read whole; repeated rows each get a row and are one article of their host;
an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import ship, spread_join, stage

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style noscript template iframe svg canvas textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav aside footer form button menu dialog head input label fieldset legend option".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead banner cookie cookies consent gdpr notice notices"
    " alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist reply replies respond disqus"
    " social share sharing related newsletter subscribe subscription login signin signup search popup modal overlay widget pagination pager paywall toolbar".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPACE = re.compile(r"\s+")
#: Deeper elements share the role of the one at this depth: paths stay short on pages of runaway nesting.
DEEPEST = 64
#: Thresholds of the method: pages and tokens that an equivalence class has at least.
LEAST_SUPPORT, LEAST_SIZE = 4, 2


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def blocks_of(page: str) -> list[tuple]:
    """Tokens of a page in order: (hash, None) of markup, (hash, text, chrome, in article, share of link text) of texts."""
    out: list[tuple] = []
    stack: list[tuple[str, bool, bool, str]] = []  # name, chrome, main, path
    chrome = main = link = 0
    parts: list[str] = []
    linked = 0

    def path() -> str:
        return stack[-1][3] if stack else ""

    def flush():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((token_hash(False, path(), text), text, chrome > 0, main > 0, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def leave(depth: int):
        nonlocal chrome, main
        while len(stack) > depth:
            _, c, m, _ = stack.pop()
            chrome -= c
            main -= m

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        found = TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0 or found is None:
            end = n if lt < 0 else lt + 1  # a lone "<" is text
            if lt >= 0 and not re.match(r"</?\Z", page[lt:]):
                parts.append(page[at:end])
            else:
                parts.append(page[at : n if lt < 0 else lt])
            if link:
                linked += end - at
            at = end
            continue
        if lt > at:
            parts.append(page[at:lt])
            if link:
                linked += lt - at
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:  # comment, doctype
            continue
        closing, rest = bool(found[1] or found[4]), found[3] if found[2] else found[6]
        if name in BLOCKS:
            flush()
        if closing:
            out.append((token_hash(True, path(), f"/{name}"), None))
            if name == "a":
                link = max(0, link - 1)
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                leave(depth)
            continue
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(rest)} if "=" in rest else {}
        label = f"{name} {attrs.get('class', '')} {attrs.get('id', '')}".lower()
        out.append((token_hash(True, path(), label), None))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if name == "a":
            link += 1
            continue
        if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            leave(len(stack) - 1)
        if name not in BLOCKS and name not in CHROME and not attrs:
            continue  # inline formatting encloses nothing that matters
        if name == "p":
            continue
        is_main = name in MAIN or attrs.get("role", "").lower() in MAIN
        bad = name in CHROME or (name == "header" and not main) or attrs.get("role", "").lower() in ROLES
        if not bad and not is_main and name not in ("body", "html"):
            bad = bool(WORDS.intersection(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())))
        stack.append((name, bad, is_main, f"{path()}>{label}" if len(stack) < DEEPEST else path()))
        chrome += bad
        main += is_main
    flush()
    return out


def token_hash(markup: bool, path: str, value: str) -> int:
    """A token's 63-bit name; markup tokens are odd."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{value}") >> 2 << 1 | markup


def article_hash(tokens: list[tuple]) -> int:
    """A name for what a page says outside of its menus and the like."""
    art = xxhash.xxh3_64()
    for x in tokens:
        if x[1] is not None and not x[2] and x[4] < 0.5:
            art.update(x[1])
    return art.intdigest() >> 1


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, art, seq): the token names in order of one page of each different article; of copies, the least by hash."""

    def run(batches):
        for batch in batches:
            arts, seqs = [], []
            for page in batch.column(1).to_pylist():
                tokens = blocks_of(page or "")
                arts.append(article_hash(tokens))
                seqs.append([x[0] for x in tokens])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arts, pa.int64()), pa.array(seqs, pa.list_(pa.int64()))], ["host", "art", "seq"])

    seen = pages.where("host <> ''").mapInArrow(run, "host string, art long, seq array<long>")
    return seen.groupBy("host", "art").agg(F.min(F.struct(F.xxhash64("seq").alias("h"), "seq")).alias("x")).select("host", "art", "x.seq")


def candidate_classes(reps: DataFrame) -> DataFrame:
    """(host, tokens: array of token, class, size, rank) of the classes that reach the thresholds; a higher rank goes first."""

    def count(batches):
        for batch in batches:
            hosts, arts, tokens, times = [], [], [], []
            for host, art, seq in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seen: dict[int, int] = {}
                for t in seq:
                    seen[t] = seen.get(t, 0) + 1
                hosts += [host] * len(seen)
                arts += [art] * len(seen)
                tokens += seen.keys()
                times += seen.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(arts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(times, pa.int32())], ["host", "art", "token", "times"]
            )

    flat = reps.mapInArrow(count, "host string, art long, token long, times int")
    vectors = flat.groupBy("host", "token").agg(F.count(F.lit(1)).alias("support"), F.sum("times").alias("total"), F.bit_xor(F.xxhash64("art", "times")).alias("vector"))
    # most tokens are a page's own text: they end here
    vectors = vectors.where(F.col("support") >= LEAST_SUPPORT)
    # every page of its support has all tokens of a class, so a class is no larger than a page
    own = vectors.groupBy("host", F.xxhash64("support", "vector").alias("class")).agg(
        F.collect_list("token").alias("own"), F.first("support").alias("support"), F.first("total").alias("total")
    )
    large = own.where((F.size("own") >= LEAST_SIZE) & F.exists("own", lambda t: t % 2 == 1))
    # classes of a host in order; each has tokens of one page, so they are at most the tokens of its pages
    rank = F.row_number().over(Window.partitionBy("host").orderBy("support", F.desc("total"), F.size("own"), "class"))
    rows = large.select("host", "class", F.size("own").alias("size"), rank.alias("rank"), F.explode("own").alias("token"))
    return rows.groupBy("host").agg(F.collect_list(F.struct("token", "class", "size", "rank")).alias("tokens"))


def class_orders(seq: list[int], classes: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, ...] | None]:
    """*classes*: token to class, class size, and more.  The order of each class's tokens on a page; None where they do not come in one order, again and again."""
    own: dict[int, list[int]] = {}
    for t in seq:
        if t in classes:
            own.setdefault(classes[t][0], []).append(t)
    out: dict[int, tuple[int, ...] | None] = {}
    for c, tokens in own.items():
        size = classes[tokens[0]][1]
        whole = len(tokens) % size == 0 and len(set(tokens[:size])) == size
        out[c] = tuple(tokens[:size]) if whole and tokens == tokens[:size] * (len(tokens) // size) else None
    return out


def class_parents(seq: list[int], places: dict[int, tuple[int, int, int, int]]) -> dict[int, tuple[int, int] | None]:
    """The slot (class, place) around each ordered class's occurrences on a page, of the classes of higher rank.

    None where it is not one, or where an occurrence overlaps one of a class of higher rank.
    *places*: token to class, place, class size and rank.
    """
    out: dict[int, tuple[int, int] | None] = {}
    open_: dict[int, list[int]] = {}  # class: start, last token's position, its place, rank
    for at, t in enumerate(seq):
        if t not in places:
            continue
        c, i, size, rank = places[t]
        if i == 0:
            around = max(((x[0], k, x[2]) for k, x in open_.items() if x[3] > rank), default=(0, 0, 0))[1:]
            out[c] = around if out.get(c, around) == around else None
            open_[c] = [at, at, 0, rank]
        else:
            mine = open_[c]
            for k, x in open_.items():
                if x[0] > mine[1]:  # begun in the slot that ends here, and not ended in it
                    out[k if x[3] < rank else c] = None
            mine[1:3] = [at, i]
        if i == size - 1:
            del open_[c]
    return out


def _host_tokens(batch: pa.RecordBatch, memo: dict, fields: tuple[str, ...]) -> list[dict]:
    """Per row of *batch* its host's tokens, as a dict of tuples of *fields*; read once a host, not once a page."""
    out = []
    hosts, tokens = batch.column(batch.schema.get_field_index("host")).to_pylist(), batch.column(batch.schema.get_field_index("tokens"))
    for i, host in enumerate(hosts):
        if host not in memo:
            if len(memo) >= 1000:
                memo.clear()
            memo[host] = {x["token"]: tuple(x[f] for f in fields) for x in tokens[i].as_py() or ()}
        out.append(memo[host])
    return out


def _by_host(rows: DataFrame, templates: DataFrame, counts: DataFrame, how: str) -> DataFrame:
    """*rows* with their host's tokens; a host with a large share of all pages is no task of its own."""
    facts = counts.join(templates, "host")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    return spread_join(rows, facts, ["host"], "n", total, how)


def template_tokens(pages: DataFrame) -> DataFrame:
    """Per host: the tokens of its valid classes, as array of (token, class, place, size)."""
    reps = stage(page_tokens(pages), "page-tokens")
    counts = stage(reps.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SUPPORT), "hosts")
    classes = stage(candidate_classes(reps), "classes")

    def check_order(batches):
        memo: dict = {}
        for batch in batches:
            out = [[], [], [], []]
            for host, seq, classes in zip(*(batch.column(k).to_pylist() for k in ("host", "seq")), _host_tokens(batch, memo, ("class", "size", "rank")), strict=True):
                for c, order in class_orders(seq, classes).items():
                    rank = next(x[2] for x in classes.values() if x[0] == c)
                    for v, x in zip(out, (host, c, rank, order), strict=True):
                        v.append(x)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["host", "class", "rank", "own"])

    found = _by_host(reps, classes, counts, "inner").mapInArrow(check_order, "host string, class long, rank int, own array<long>")
    h = F.coalesce(F.xxhash64("own"), F.lit(0))
    same = found.groupBy("host", "class", "rank").agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.first("own", True).alias("own"), F.count_if(F.col("own").isNull()).alias("bad"))
    ordered = same.where("bad = 0 and lo = hi").select("host", "class", "rank", F.size("own").alias("size"), F.posexplode("own").alias("place", "token"))
    ordered = stage(ordered.groupBy("host").agg(F.collect_list(F.struct("token", "class", "place", "size", "rank")).alias("tokens")), "ordered")

    def check_nesting(batches):
        memo: dict = {}
        for batch in batches:
            out = [[], [], []]
            for host, seq, places in zip(*(batch.column(k).to_pylist() for k in ("host", "seq")), _host_tokens(batch, memo, ("class", "place", "size", "rank")), strict=True):
                for c, around in class_parents(seq, places).items():
                    for v, x in zip(out, (host, c, None if around is None else f"{around[0]}:{around[1]}"), strict=True):
                        v.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["host", "class", "around"])

    found = _by_host(reps, ordered, counts, "inner").mapInArrow(check_nesting, "host string, class long, around string")
    same = found.groupBy("host", "class").agg(F.min("around").alias("lo"), F.max("around").alias("hi"), F.count_if(F.col("around").isNull()).alias("bad"))
    nested = same.where("bad = 0 and lo = hi").select("host", "class")
    rows = ordered.select("host", F.inline("tokens")).join(nested, ["host", "class"])
    return rows.groupBy("host").agg(F.collect_list(F.struct("token", "class", "place", "size")).alias("tokens"))


def extract(page: str | None, template: dict[int, tuple[int, int, int]]) -> str:
    """The text of the slots of one page that hold its main content; *template*: token to class, place and class size."""
    tokens = blocks_of(page or "")
    marked = any(x[1] is not None and x[3] and not x[2] for x in tokens)
    blocks: list[tuple[int, tuple]] = []  # slot, text block
    open_: list[list[int]] = [[0, 0, 0]]  # class, last place, its slot
    slots = 0
    for x in tokens:
        known = template.get(x[0]) if template else None
        if known is None:
            if x[1] is not None and not x[2] and (x[3] or not marked):
                blocks.append((open_[-1][2], x))
            continue
        c, i, size = known
        k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == c and open_[k][1] < i), None)
        slots += 1
        if k is not None:
            del open_[k + 1 :]
            open_[k][1:] = [i, slots]
        else:
            open_.append([c, i, slots])
        if i == size - 1:  # the class ends: the slot around it goes on
            open_.pop()
    kept = []
    size, linked = [0] * (slots + 1), [0.0] * (slots + 1)
    for slot, x in blocks:
        size[slot] += len(x[1])
        linked[slot] += x[4] * len(x[1])
    for slot, x in blocks:
        if marked or linked[slot] < 0.5 * size[slot]:
            kept.append(x[1])
    return "\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    src = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    templates = stage(template_tokens(src.select("host", "html")), "templates")
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches):
        memo: dict = {}
        for batch in batches:
            texts = [extract(page, template) for page, template in zip(batch.column(2).to_pylist(), _host_tokens(batch, memo, ("class", "place", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    counts = src.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    joined = _by_host(src, templates, counts, "left").select("page_id", "url", "html", "host", "tokens")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


ship(__name__)
