"""Main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens: element paths and block texts. The occurrence vector of an element
path (how often it occurs in which pages of its host) is summed into a digest, so those with equal vectors
meet by aggregation and form a class. A class is valid if its tokens come in one order on every page and
nest alike in the other classes; a class that crosses one of more pages is cut there, and its parts nest. The
valid classes, each inside a gap of the one around it, are the host's template; the gaps are its slots. A text that
stands in nearly all pages of its slot is template too, a slot that holds mostly links is a menu. What is
left of the slots is extracted, of those inside article or main elements where the page has such.

What HTML itself marks as something else than the article (nav, footer, form, hidden elements and so on)
is left out before that, and so are containers and inline elements whose whole name says so. Names that an article's own sections may have as well (`related`, `notice`, `search`)
are evidence only: inside an article such an element goes if its host repeats it page after page, or if it
holds mostly links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, mapped, stored

#: Bytes of templates that are sent to every executor; more are met by a join on the host.
BROADCAST_BYTES = 48 << 20

#: Characters of an element's path, beyond which what stands above it is named by a hash.
LONGEST_PATH = 1000

_OUT = frozenset("nav footer aside form menu dialog button select option textarea head noscript template iframe object svg canvas audio video script style title".split())
#: What containers and inline elements may be called by class, id or role if they are no part of an article; the same for names that sections of an article may have too; and words that only lay out.
_ROLES = frozenset("ad ads advert adverts advertisement advertising sponsored nav navbar navigation menu sidebar comment comments disqus response responses reply replies cookie cookies consent gdpr newsletter subscription footer breadcrumb breadcrumbs pagination pager contentinfo".split())
_MAYBE = frozenset("banner sponsor promo notice popup modal subscribe share sharing social related recommended login signup search complementary".split())
_HEADERS = frozenset(("header", "masthead"))
_LAYOUT = frozenset("box block list section area wrap wrapper container inner outer top bottom left right main side slot unit bar widget item items group panel site page the links nav".split())
_NAMED_BY = frozenset("div section ul ol dl table td center header span a em strong b i small ins font label figure details".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCKS - {"html", "body", "head", "title"}
_RAW = frozenset("script style noscript template iframe textarea svg title".split())
# an attribute's value may be quoted or hold stray quotes; no part of a tag is read twice
_TOKEN = re.compile(r"<!--(?P<comment>)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?>[^>=]+|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>|<[!?/][^>]*+>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _RAW}
_TAG = re.compile(r"<[!?/a-zA-Z]")
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z]+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, tag, whether it ends, attributes) of each tag; comments and what must not be read as markup have no tag name. Each character is passed a bounded number of times, however broken the page."""
    last, at = page.rfind(">") + 1, 0
    while m := _TOKEN.search(page, at, last):
        at = m.end()
        if m["comment"] is not None:
            at = found + 3 if (found := page.find("-->", at)) >= 0 else len(page)
            yield m.start(), at, "", False, ""
            continue
        tag = (m["tag"] or "").lower()
        if tag in _RAW and not m["end"]:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            yield m.start(), at, "", False, ""
            continue
        yield m.start(), at, tag, bool(m["end"]), m["rest"] or ""
    if at < len(page) and (m := _TAG.search(page, max(at, last))):  # a tag that the page's end cuts
        yield m.start(), len(page), "", False, ""


def _named(tag: str, attributes: str, own: bool = True) -> tuple[str, bool, bool]:
    """What class, id and role call an element (digits left out), whether it is hidden or called something else than an article's part, and whether its name only suggests so; outside of articles a suggestion is enough, and a header is out too."""
    names, out, maybe = [], False, False
    for kind, a, b, c in _NAMED.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and _UNSEEN.search(value):
            out = True
        elif kind in ("class", "id", "role"):
            for token in value.split():
                words = _WORDS.findall(token)
                names += words
                said = [w for w in words if w not in _LAYOUT] or words
                if tag in _NAMED_BY and said and all(w in _ROLES or w in _MAYBE or not own and w in _HEADERS for w in said):
                    if own and any(w in _MAYBE for w in said):
                        maybe = True
                    else:
                        out = True
    return ".".join(names[:6]), out, maybe and not out


def items_of(page: str) -> list[tuple[str, str | None, bool, int]]:
    """The page in order: (path, None, ..) where an element starts, (path/, None, ..) where it ends, (path, text, whether in an article or main element, characters of links) for blocks."""
    return [x[:4] for x in judged_items(page)]


def judged_items(page: str) -> list[tuple[str, str | None, bool, int, str]]:
    """As items_of, with the path of the element around whose name suggests that it is no content (empty if there is none).

    Blocks of elements that are no content are left out. A form is content if it holds half of all text.
    """
    stack: list[tuple[str, str, bool, bool, int, str]] = []  # tag, path, left out, in an article, number of its form or name, suggested
    items: list[tuple[str, str | None, bool, int, int, str]] = []
    text: list[str] = []
    links = forms = linked = 0
    open_tags: Counter = Counter()
    skipped, depth = "", 0  # an inline element that is left out

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined and not (stack and stack[-1][2]):
                _, path, _, own, form, maybe = stack[-1] if stack else ("", "", False, False, 0, "")
                items.append((path, joined, own, min(links, len(joined)), form, maybe))
        links = 0

    def said(piece: str) -> None:
        nonlocal links
        if not skipped:
            piece = html.unescape(piece)
            text.append(piece)
            if linked:
                links += len(piece)

    def closed() -> str:
        tag, path, *_ = stack.pop()
        items.append((path + "/", None, False, 0, 0, ""))
        return tag

    at = 0
    for start, stop, tag, ends, attributes in _tokens(page):
        if start > at:
            said(page[at:start])
        at = stop
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _BLOCKS and tag not in _OUT:
            if ends:
                if tag == "a":
                    linked = 0
                if tag == skipped:
                    depth -= 1
                    if not depth:
                        skipped = ""
            else:
                if tag == "a":
                    linked = 1
                if skipped:
                    depth += tag == skipped
                elif tag not in _VOID and attributes and any(_named(tag, attributes)[1:]):
                    skipped, depth = tag, 1
            continue
        flush()
        skipped, linked = "", 0
        if ends:
            if open_tags[tag]:
                while (gone := closed()) != tag:
                    open_tags[gone] -= 1
                open_tags[tag] -= 1
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            open_tags[closed()] -= 1
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            open_tags[closed()] -= 1
        _, above, up_out, up_own, form, maybe = stack[-1] if stack else ("", "", False, False, 0, "")
        names, out, may = _named(tag, attributes, up_own) if attributes else ("", False, False)
        if tag == "form":
            forms += 1
            form = form or forms
        out = up_out or out or tag in _OUT and tag != "form" or tag == "header" and not up_own
        if len(above) > LONGEST_PATH:
            above = xxhash.xxh64_hexdigest(above)
        path = f"{above}/{tag}" + (f".{names}" if names else "")
        suggested = may and not maybe and not out
        maybe = maybe or (path if may else "")
        items.append((path, None, False, 0, 0, path if suggested else ""))
        open_tags[tag] += 1
        stack.append((tag, path, out, up_own or not out and tag in ("article", "main") or not out and names.split(".")[0] == "main", form, maybe))
    if at < len(page):
        said(page[at:])
    flush()
    kept = {0}
    if forms:
        sizes = Counter()
        for _, t, _, _, form, _ in items:
            if t:
                sizes[form] += len(t)
        kept |= {form for form, n in sizes.items() if 2 * n >= sizes.total()}
    return [(*x[:4], x[5]) for x in items if x[1] is None or x[4] in kept]


def token_of(path: str, text: str | None) -> int:
    """Texts and elements have separate tokens."""
    return xxhash.xxh64_intdigest(path if text is None else f"{path}\0{text}") - (1 << 63)


def host_of(url: Column) -> Column:
    """A url's host without www; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def sequences(pages: DataFrame) -> DataFrame:
    """From (k, u, host, p): (host, pid, tokens, chars, links, own) of every page with blocks; chars is -1 for elements, links -1 for headings, own marks blocks of an article and elements whose name suggests that they are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        for b in batches:
            rows = []
            for k, u, host, p in zip(*b.columns, strict=True):
                items = judged_items(p.as_py() or "")
                if any(x[1] for x in items):
                    tokens, chars, links, own = zip(*[(token_of(x, t), -1 if t is None else len(t), -1 if t and _is_heading(x) else n, o or t is None and bool(maybe)) for x, t, o, n, maybe in items], strict=True)
                    rows.append((host.as_py(), xxhash.xxh64_intdigest(f"{k}\0{u}") - (1 << 63), tokens, chars, links, own))
            host, pid, *arrays = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(pid, pa.int64()), *[pa.array(a, t) for a, t in zip(arrays, lists, strict=True)]], names=["host", "pid", "tokens", "chars", "links", "own"])

    return mapped(pages.select("k", "u", "host", "p"), run, "host string, pid long, tokens array<long>, chars array<int>, links array<int>, own array<boolean>")


def _is_heading(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] in _HEADINGS


def occurrences(seqs: DataFrame) -> DataFrame:
    """(host, token, n, v1, v2, maybe): pages that hold an element, the digest of its occurrence vector, and whether its name suggests that it is no content. Summed in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for host, pid, tokens, chars, own in zip(*(b.column(c).to_pylist() for c in ("host", "pid", "tokens", "chars", "own")), strict=True):
                suggested = {t for t, x, o in zip(tokens, chars, own, strict=True) if x < 0 and o}
                for token, n in Counter(t for t, x in zip(tokens, chars, strict=True) if x < 0).items():
                    v = xxhash.xxh64_intdigest(f"{pid}\0{n}")
                    s = sums.setdefault((host, token), [0, 0, 0, token in suggested])
                    s[0] += 1
                    s[1] += v & 0x7FFFFFFF
                    s[2] += v >> 33
            yield _columns([(*k, *s) for k, s in sums.items()], [pa.string(), *[pa.int64()] * 4, pa.bool_()], ["host", "token", "n", "v1", "v2", "maybe"])

    rows = mapped(seqs.select("host", "pid", "tokens", "chars", "own"), run, "host string, token long, n long, v1 long, v2 long, maybe boolean")
    return rows.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("n", "v1", "v2")], F.max("maybe").alias("maybe"))


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def equivalence_classes(counted: DataFrame, hosts: DataFrame, *, support: int, share: float) -> DataFrame:
    """(host, token, cid, n): tokens of classes of two and more, on at least `support` pages and `share` of the host's."""
    vector = ["host", "n", "v1", "v2"]
    often = counted.join(hosts, "host").where((F.col("n") >= support) & (F.col("n") >= share * F.col("pages"))).drop("pages")
    large = often.groupBy(*vector).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(*vector)
    return often.join(large, vector, "left_semi").select("host", "token", F.xxhash64(*vector).alias("cid"), "n")


def walk(tokens: list[int], class_of: dict[int, tuple[int, int]]) -> tuple[list[tuple], dict[tuple[int, int], int], set[tuple[int, int]]]:
    """A page's sequence through classes, which are (pages, id): each token's slot (class, gap) as it is met, each class's form as a hash, and classes that are out of order.

    The first round of a class sets its order, and every further round must follow it. A class is open from
    the first to the last of its tokens, and what stands between is in one of its gaps. Where two classes
    cross, that of fewer pages is cut there and goes on inside the other's next gap; a class's form is its
    order and the places where it is cut. What stands outside of all is in the gap of no class.
    """
    met: dict[tuple[int, int], dict[int, int]] = {}
    for t in tokens:
        if (c := class_of.get(t)) is not None:
            met.setdefault(c, {}).setdefault(t, len(met[c]))
    cuts: dict[tuple[int, int], set[int]] = {c: set() for c in met}
    bad: set[tuple[int, int]] = set()
    stack: list[list] = []  # class, next place
    slots: list[tuple] = []
    expected: dict[tuple[int, int], int] = {}
    for t in tokens:
        c = class_of.get(t)
        if c is not None:
            i, size = met[c][t], len(met[c])
            if i != expected.get(c, 0):
                bad.add(c)
            expected[c] = (i + 1) % size
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
            if at is not None:
                for open_class, place in stack[at + 1 :]:
                    if open_class[0] > c[0]:
                        cuts[c].add(i)
                        del stack[at]
                        at = None
                        break
                    cuts[open_class].add(place)
                else:
                    del stack[at + 1 :]
            if at is None:
                stack.append([c, i + 1])
            else:
                stack[at][1] = i + 1
            if i == size - 1:
                stack.pop()
        slots.append((stack[-1][0], stack[-1][1]) if stack else ((0, 0), 0))
    forms = {c: xxhash.xxh64_intdigest(repr((list(m), sorted(cuts[c]))).encode()) - (1 << 63) for c, m in met.items()}
    return slots, forms, bad


def valid_classes(seqs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of `classes` that have one form on every page: an order that all rounds follow, cut by other classes at the same places. Pages that are all copies of one show no template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list] = {}
            for host, tokens, chars, known, pages, cids in zip(*(b.column(c).to_pylist() for c in ("host", "tokens", "chars", "known", "pages", "cids")), strict=True):
                whole = xxhash.xxh64_intdigest(repr([t for t, x in zip(tokens, chars, strict=True) if x >= 0]).encode()) - (1 << 63)
                _, forms, bad = walk(tokens, classes_of(known, pages, cids))
                for c, o in forms.items():
                    s = sums.setdefault((host, c[1]), [o, o, whole, whole, False])
                    s[:] = min(s[0], o), max(s[1], o), min(s[2], whole), max(s[3], whole), s[4] or c in bad
            yield _columns([(*k, *s) for k, s in sums.items()], [pa.string(), *[pa.int64()] * 5, pa.bool_()], ["host", "cid", "low", "high", "least", "most", "bad"])

    rows = mapped(_with_host(seqs.select("host", "tokens", "chars"), _listed(classes)).where("known is not null"), run, "host string, cid long, low long, high long, least long, most long, bad boolean")
    lows, highs = [F.min(c).alias(c) for c in ("low", "least")], [F.max(c).alias(c) for c in ("high", "most", "bad")]
    good = rows.groupBy("host", "cid").agg(*lows, *highs).where("low = high and least <> most and not bad")
    return classes.join(good, ["host", "cid"], "left_semi")


def _listed(classes: DataFrame) -> DataFrame:
    """One row a host; as a class stands on a share of the pages, the lists are bounded by what pages hold."""
    both = classes.groupBy("host").agg(F.collect_list(F.struct("token", "n", "cid")).alias("x"))
    return cut(both.select("host", F.col("x.token").alias("known"), F.col("x.n").alias("pages"), F.col("x.cid").alias("cids")))


def classes_of(known: list[int], pages: list[int], cids: list[int]) -> dict[int, tuple[int, int]]:
    return dict(zip(known, zip(pages, cids, strict=True), strict=True))


def _with_host(rows: DataFrame, by_host: DataFrame) -> DataFrame:
    """Rows with what is known of their host. That is broadcast only if its bytes have been added up to be few; else Spark splits a hot host's rows."""
    lists = [c for c in by_host.columns if c != "host"]
    size = by_host.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) * 8 for c in lists), F.lit(64)).cast("long"))).first()[0] or 0
    return rows.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", "left")


def slot_key(slot: tuple) -> int:
    return xxhash.xxh64_intdigest(repr(slot)) - (1 << 63)


def slot_texts(seqs: DataFrame, by_host: DataFrame) -> DataFrame:
    """(host, slot, token, n, chars, links): for each slot (token 0) and each text in it the pages; characters and those of links outside of articles and headings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for host, tokens, chars, links, own, known, pages, cids in zip(*(b.column(c).to_pylist() for c in ("host", "tokens", "chars", "links", "own", "known", "pages", "cids")), strict=True):
                slots, _, _ = walk(tokens, classes_of(known, pages, cids))
                here: dict[tuple, list[int]] = {}
                for t, n, k, o, slot in zip(tokens, chars, links, own, slots, strict=True):
                    if n >= 0:
                        where = here.setdefault((slot_key(slot), 0), [0, 0])
                        if not o and k >= 0:
                            where[0] += n
                            where[1] += k
                        here.setdefault((slot_key(slot), t), [0, 0])
                for (slot, t), (n, k) in here.items():
                    s = sums.setdefault((host, slot, t), [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + n, s[2] + k
            yield _columns([(*k, *s) for k, s in sums.items()], [pa.string(), *[pa.int64()] * 5], ["host", "slot", "token", "n", "chars", "links"])

    rows = mapped(_with_host(seqs.drop("pid"), by_host).where("known is not null"), run, "host string, slot long, token long, n long, chars long, links long")
    return rows.groupBy("host", "slot", "token").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])


def templates(pages: DataFrame, *, support: int = 3, share: float = 0.05, fixed: float = 0.8) -> DataFrame:
    """From (k, u, host, p): one row for each host with valid classes: their tokens (known, cids), texts that are template (`fixed`, `often`: hashes of slot and text, pages), slots that are menus, and elements that pages repeat and whose name suggests that they are no content (such hosts have a row without classes too)."""
    seqs = stored(sequences(pages.where("host <> ''")))
    hosts = seqs.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = cut(occurrences(seqs))
    classes = cut(equivalence_classes(counted, hosts, support=support, share=share))
    again = counted.where("maybe").join(hosts, "host").where((F.col("n") >= support) & (F.col("n") >= share * F.col("pages"))).groupBy("host").agg(F.collect_list("token").alias("repeated"))
    by_host = _listed(valid_classes(seqs, classes))
    found = cut(slot_texts(seqs, by_host))
    slots = found.where("token = 0").select("host", "slot", F.col("n").alias("within"), (F.col("links") * 2 > F.col("chars")).alias("menu"))
    often = found.where((F.col("token") != 0) & (F.col("n") >= support)).drop("chars", "links").join(slots.where(F.col("within") >= support), ["host", "slot"]).where(F.col("n") >= fixed * F.col("within"))
    texts = often.groupBy("host").agg(F.collect_list(F.struct("slot", "token", "n")).alias("x")).select("host", F.col("x.slot").alias("fixed_slots"), F.col("x.token").alias("fixed_texts"), F.col("x.n").alias("often"))
    menus = slots.where("menu").join(hosts, "host").where((F.col("within") >= support) & (F.col("within") >= share * F.col("pages"))).groupBy("host").agg(F.collect_list("slot").alias("menus"))
    return by_host.join(texts, "host", "left").join(menus, "host", "left").join(again, "host", "full")


def _left_in(items: list[tuple[str, str | None, bool, int, str]], repeated: set[int] | frozenset[int]) -> list[tuple[str, str | None, bool, int]]:
    """The items without blocks of elements whose name suggests that they are no content, where the host repeats the element or it holds mostly links."""
    sizes: dict[str, list[int]] = {}
    for path, t, _, links, maybe in items:
        if t and maybe and not _is_heading(path):
            s = sizes.setdefault(maybe, [0, 0])
            s[0], s[1] = s[0] + len(t), s[1] + links
    gone = {x for x, (n, links) in sizes.items() if 2 * links > n} | {x[4] for x in items if x[4] and token_of(x[4], None) in repeated}
    return [x[:4] for x in items if x[1] is None or x[4] not in gone]


def main_text(page: str, class_of: dict[int, tuple[int, int]], fixed: dict[tuple[int, int], int], menus: set[int], repeated: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's blocks in slots, without template texts and menus.

    If nothing but template texts is left, the page is one of very many copies on its host; then only those
    that stand on the most pages are template.
    """
    items = _left_in(judged_items(page), repeated)
    tokens = [token_of(p, t) for p, t, _, _ in items]
    slots, _, _ = walk(tokens, class_of) if class_of else ([((0, 0), 0)] * len(items), {}, set())
    blocks = [(t, own, token, slot_key(slot) if class_of else 0) for (_, t, own, _), token, slot in zip(items, tokens, slots, strict=True) if t is not None]
    own = [b for b in blocks if b[1]] or [b for b in blocks if b[3] not in menus] or blocks
    kept = [b for b in own if (b[3], b[2]) not in fixed]
    if not kept:
        most = max((fixed[b[3], b[2]] for b in own), default=0)
        kept = [b for b in own if fixed[b[3], b[2]] < most] or own
    return " ".join(b[0] for b in kept)


def extracted(pages: DataFrame, *, page: str = "html", url: str = "url", key: str = "page_id", support: int = 3, share: float = 0.05, fixed: float = 0.8) -> DataFrame:
    """(key, url, text, n_chars), one row for each row of `pages`.

    text: the blocks of the page's slots in order, each with its white space turned into single spaces and
    its character references decoded, joined by one space; empty if there are none. A class needs
    `support` pages and `share` of its host's, a text `fixed` of its slot's pages to be template; a host of
    fewer pages has no template, and a page with no (or an odd) url no host: they are read by their own
    elements. Null pages are empty, an empty table gives an empty one, and columns of other names are
    ignored, whatever they are called. Repeated rows stay repeated. Broken markup is read to its end. Counts
    are summed in tasks before the shuffle, so a host with most pages is no single task's; pages
    themselves are not shuffled while the templates are few enough to be sent to all.
    """
    slim = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), host_of(F.col(url).cast("string")).alias("host"), F.col(page).cast("string").alias("p"))
    met = _with_host(slim, cut(templates(slim, support=support, share=share, fixed=fixed))).select("k", "u", "host", "p", "known", "pages", "cids", "fixed_slots", "fixed_texts", "often", "menus", "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, tuple] = {}
            texts = []
            for i, (host, p) in enumerate(zip(b.column("host").to_pylist(), b.column("p"), strict=True)):
                if host not in known:
                    tokens, counts, cids, slots, fixed_texts, often, menus, repeated = (b.column(c)[i].as_py() or [] for c in ("known", "pages", "cids", "fixed_slots", "fixed_texts", "often", "menus", "repeated"))
                    known[host] = classes_of(tokens, counts, cids), dict(zip(zip(slots, fixed_texts, strict=True), often, strict=True)), set(menus), set(repeated)
                texts.append(main_text(p.as_py() or "", *known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["k", "u", "text"])

    out = mapped(met, run, f"k {slim.schema['k'].dataType.simpleString()}, u string, text string")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
