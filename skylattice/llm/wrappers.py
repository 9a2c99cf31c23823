"""Main text of web pages by tag paths, with a wrapper shown for each host.

A page is a stream of block tags, each followed by a text slot; inline markup is part of the text. Runs of equal stretches
are folded into repeated groups. The streams of one host are aligned one after the other into a union-free regular
expression: where tags differ, what only one side has becomes optional, and a stretch that one side repeats becomes a
repeated group; text slots take any text. Every distinct stream is then matched against its host's expression: a slot of the
expression whose text is the same on all of five pages or more, while these pages differ, belongs to the template and gives no
text of pages without marked elements. Between the other slots, main text is chosen by tag paths, the open elements around a
text: by what they are (navigation, forms, notices, comments), by whether their text is the same on all pages of the host, and
by how much text they hold.

Distinct streams are few, so each host's alignment sees one row for each distinct stream, in two levels: hosts are split by
the stream's hash first, and the partial expressions are aligned afterwards. All pages count.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.url_rules import host_and_path
from skylattice.llm.words import pieces
from skylattice.operators.materialise import materialise, task_slots

#: Texts of these elements are no text of the page.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|canvas"
#: Elements that are part of a block's text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be missing: a new one of the same kind, or the end of what is around it, ends them.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option caption".split())
#: Elements that never hold main text.
ASIDE = frozenset("nav header footer aside form menu button dialog fieldset figcaption address head".split())
#: Parts of class names and ids of such elements.
ASIDE_NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
BESIDE = frozenset("no non not with without has have".split())
#: Splits of a host's distinct streams, and the longest stretch looked for as a repeated group.
SPLITS, LONGEST = 64, 24
#: Wrapper tables of at most this many bytes go to all tasks; larger ones are joined by host.
SMALL = 32 << 20

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[0-9]+")


@lru_cache(1 << 16)
def _label(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role, without numbers: what a template keeps from page to page."""
    names = set()
    for m in _ATTR.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            # what follows such a word tells what is beside the element or not there, as in no-sidebar or page-with-comments
            names.update(w for w in takewhile(lambda w: w not in BESIDE, _NAME.findall(name)) if w.isalpha())
    return ".".join([tag, *sorted(names)])


def stream(page: str) -> tuple[list[str], list[str]]:
    """The block tags of a page, and the text after each; before the first tag stands the tag `html`."""
    tags, texts, open_text = ["html"], [], []

    def close() -> None:
        texts.append(" ".join(html.unescape("".join(open_text)).split()))
        open_text.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        open_text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                open_text.append(" ")
            continue
        ending = bool(m[2] or m[5])
        if name in ("html", "body") or (ending and name in LOOSE):
            # end tags that may be missing only end the block
            if texts or "".join(open_text).strip() or len(tags) > 1:
                close()
                tags.append("~")
            continue
        close()
        tags.append(("/" + name) if ending else _label(name, m[4] or m[7] or ""))
    open_text.append(page[at:])
    close()
    return _merged(tags, texts)


def _merged(tags: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Without block ends that no text follows."""
    keep = [i for i, t in enumerate(tags) if t != "~" or texts[i]]
    return [tags[i] for i in keep], [texts[i] for i in keep]


# A node is (tag, many, optional) or (tuple of nodes, many, optional); `many` marks a group that repeats.
Node = tuple


def fold(tags: list[str]) -> tuple[list[Node], list[int]]:
    """Nodes of a stream with runs of equal stretches folded, and for each tag the number of its slot.

    Slots are numbered in order over the nodes with groups opened once.
    """
    items: list[tuple[Node, list[list[int]]]] = [((t, False, False), [[i]]) for i, t in enumerate(tags)]
    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST + 1):
            out, i = [], 0
            keys = [x[0] for x in items]
            while i < len(items):
                unit = keys[i : i + size]
                if i + 2 * size > len(items) or keys[i] != keys[i + size] or unit != keys[i + size : i + 2 * size] or (size == 1 and keys[i][1]):
                    out.append(items[i])
                    i += 1
                    continue
                j = i + size
                while keys[j : j + size] == unit:
                    j += size
                slots: list[list[int]] = [[] for _ in range(sum(len(items[i + k][1]) for k in range(size)))]
                for start in range(i, j, size):
                    own = [s for k in range(size) for s in items[start + k][1]]
                    for s, more in zip(slots, own, strict=True):
                        s.extend(more)
                out.append(((tuple(unit), True, False), slots))
                i, changed = j, True
            items = out
    slot_of, at = [0] * len(tags), 0
    for _, slots in items:
        for s in slots:
            for tag in s:
                slot_of[tag] = at
            at += 1
    return [x[0] for x in items], slot_of


def _plain(node: Node) -> tuple:
    """The tags of a node without marks, for comparison."""
    return (node[0],) if isinstance(node[0], str) else tuple(t for n in node[0] for t in _plain(n))


def _grouped(nodes: list[Node], units: set[tuple]) -> list[Node]:
    """Single stretches that the other side repeats, as groups."""
    for unit in sorted(units, key=len, reverse=True):
        out, i = [], 0
        while i < len(nodes):
            j, tags = i, ()
            while j < len(nodes) and len(tags) < len(unit) and not nodes[j][1]:
                tags += _plain(nodes[j])
                j += 1
            if tags == unit:
                out.append((tuple((n[0], n[1], n[2]) for n in nodes[i:j]), True, False))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _compared(wrapper: list[Node], page: list[Node]) -> tuple[list[Node], list[Node], list[list[tuple]], list[list[int]]]:
    """Both sides with the groups of the other, their keys, and the most tags that their rests from (i, j) on have in common."""
    wrapper = _grouped(wrapper, {_plain(n) for n in page if n[1]})
    page = _grouped(page, {_plain(n) for n in wrapper if n[1]})
    keys = [[(_plain(n), n[1]) if not n[1] else (_plain(n)[0], True) for n in side] for side in (wrapper, page)]
    n, m = len(wrapper), len(page)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + len(keys[0][i][0]) if keys[0][i] == keys[1][j] else 0)
    return wrapper, page, keys, best


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The union-free expression that covers both."""
    wrapper, page, keys, best = _compared(wrapper, page)
    n, m = len(wrapper), len(page)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and keys[0][i] == keys[1][j] and best[i][j] == best[i + 1][j + 1] + len(keys[0][i][0]):
            a, b = wrapper[i], page[j]
            inner = a[0] if a[0] == b[0] or isinstance(a[0], str) else tuple(align(list(a[0]), list(b[0])))
            out.append((inner, a[1], a[2] or b[2]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((wrapper[i][0], wrapper[i][1], True))
            i += 1
        else:
            out.append((page[j][0], page[j][1], True))
            j += 1
    return out


def matched(wrapper: list[Node], page: list[Node]) -> list[int]:
    """For each slot of the page its slot in the expression; -1 where the expression has none."""
    wrapper, page, keys, best = _compared(wrapper, page)
    n, m = len(wrapper), len(page)
    out, i, j, at = [], 0, 0, 0
    while j < m:
        if i < n and keys[0][i] == keys[1][j] and best[i][j] == best[i + 1][j + 1] + len(keys[0][i][0]):
            a, b = wrapper[i][0], page[j][0]
            inner = [0] if isinstance(a, str) else matched(list(a), list(b))
            out += [at + k if k >= 0 else -1 for k in inner]
            at += len(_plain(wrapper[i]))
            i, j = i + 1, j + 1
        elif i < n and best[i + 1][j] >= best[i][j + 1]:
            at += len(_plain(wrapper[i]))
            i += 1
        else:
            out += [-1] * len(_plain(page[j]))
            j += 1
    return out


def expression(nodes: list[Node]) -> str:
    """The wrapper as a regular expression over tags and text slots (#)."""
    def one(n: Node) -> str:
        body = f"<{n[0]}>#" if isinstance(n[0], str) else f"({' '.join(map(one, n[0]))})"
        return body + {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[n[1], n[2]]

    return " ".join(map(one, nodes))


def paths(nodes: list[Node]) -> list[str]:
    """For each slot the open elements around its text, outermost first."""
    out: list[str] = []
    stack: list[str] = ["html"]

    def walk(some) -> None:
        for n in some:
            if not isinstance(n[0], str):
                walk(n[0])
                continue
            tag = n[0]
            if tag.startswith("/"):
                name = tag[1:]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].split(".")[0] == name:
                        del stack[k:]
                        break
            elif tag != "html" and tag != "~":
                name = tag.split(".")[0]
                if name in LOOSE:
                    while len(stack) > 1 and stack[-1].split(".")[0] in LOOSE and not (name in ("p", "li", "dt", "dd") and stack[-1].split(".")[0] in ("td", "th", "li", "dd") and name != stack[-1].split(".")[0]):
                        stack.pop()
                elif stack[-1].split(".")[0] == "p":
                    stack.pop()
                if name not in VOID:
                    stack.append(tag)
            elif tag == "~" and stack[-1].split(".")[0] in LOOSE:
                stack.pop()
            out.append("/".join(stack))

    walk(nodes)
    return out


def _aside(label: str) -> bool:
    name, *names = label.split(".")
    return name in ASIDE or not ASIDE_NAMES.isdisjoint(names)


def _main(label: str) -> bool:
    name, *names = label.split(".")
    return name in ("article", "main") or not MAIN_NAMES.isdisjoint(names)


@lru_cache(1 << 16)
def _free(path: str) -> bool:
    return not any(map(_aside, path.split("/")))


@lru_cache(1 << 16)
def _marked(path: str) -> bool:
    return _free(path) and any(map(_main, path.split("/")))


def same_paths(stats: dict[str, tuple[int, int, bool]]) -> set[str]:
    """The paths of the template's own text: the same on all of five pages or more."""
    return {p for p, (pages, _, equal) in stats.items() if pages >= 5 and equal}


def main_paths(stats: dict[str, tuple[int, int, bool]]) -> set[str]:
    """The paths that hold main text. stats: pages, characters and whether all texts are equal, by path.

    Where an element is marked as main content, its paths; else the smallest container with most of the text that differs
    between pages. Text that is the same on all of five pages or more belongs to the template, unless it is so marked.
    """
    free = set(filter(_free, stats))
    marked = set(filter(_marked, free))
    if sum(stats[p][1] for p in marked):
        return marked
    own = free - same_paths(stats)
    weight: dict[str, int] = defaultdict(int)
    for p in own:
        labels = p.split("/")
        for k in range(1, len(labels) + 1):
            weight["/".join(labels[:k])] += stats[p][1]
    total = sum(stats[p][1] for p in own)
    blocks = LOOSE | {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table"}
    holders = [p for p, w in weight.items() if w >= 0.6 * total and p.split("/")[-1].split(".")[0] not in blocks]
    top = max(holders, key=lambda p: (p.count("/"), p), default="html")
    return {p for p in own if p == top or p.startswith(top + "/")}


def _rows_of(page: str | None) -> tuple[list[Node], list[int], list[str]]:
    tags, texts = stream(page or "")
    nodes, slot_of = fold(tags)
    return nodes, slot_of, texts


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct streams by host, and statistics by host and path, summed over what the task reads.

    Pages with text in marked elements count for these only (kind m), so that they decide nothing for other pages (kind p),
    whose texts are also counted by stream and slot (kind t), with the least and greatest hash of the page's whole text.
    """
    streams: dict[tuple[str, str], int] = defaultdict(int)
    stats: dict[tuple[str, str, str], list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, "s", s, n, 0, 0, 0, 0, 0) for (h, s), n in streams.items()] + [(h, kind, p, *v) for (h, kind, p), v in stats.items()]
        streams.clear()
        stats.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 6, strict=True)], ["host", "kind", "what", "pages", "chars", "lo", "hi", "plo", "phi"])

    def count(key: tuple[str, str, str], some: list[str], whole: int) -> None:
        h = xxhash.xxh64_intdigest("\n".join(some)) >> 1
        v = stats.setdefault(key, [0, 0, h, h, whole, whole])
        v[0] += 1
        v[1] += sum(map(len, some))
        v[2], v[3], v[4], v[5] = min(v[2], h), max(v[3], h), min(v[4], whole), max(v[5], whole)

    for piece in pieces(batches, "html"):
        for url, page in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
            host = host_and_path(url)[0]
            nodes, slot_of, texts = _rows_of(page)
            shape = json.dumps(nodes)
            streams[host, shape] += 1
            where = paths(nodes)
            found: dict[str, list[str]] = defaultdict(list)
            for slot, text in zip(slot_of, texts, strict=True):
                if text:
                    found[where[slot]].append(text)
            kind = "m" if any(map(_marked, found)) else "p"
            for p, some in found.items():
                if kind == "m" and not _marked(p):
                    continue
                count((host, kind, p), some, 0)
            if kind == "p":
                whole, name = xxhash.xxh64_intdigest("\n".join(texts)) >> 1, _name_of(shape)
                by_slot: dict[int, list[str]] = defaultdict(list)
                for slot, text in zip(slot_of, texts, strict=True):
                    if text:
                        by_slot[slot].append(text)
                for slot, some in by_slot.items():
                    count((host, "t", f"{name}/{slot}"), some, whole)
        if len(streams) + len(stats) > 20_000:
            yield flush()
    yield flush()


def _name_of(shape: str) -> str:
    return xxhash.xxh64_hexdigest(shape)


def _frozen(x) -> Node:
    return tuple(_frozen(i) for i in x) if isinstance(x, list) else x


def _nodes(text: str) -> list[Node]:
    return list(_frozen(json.loads(text)))


def _aligned(some: list[str]) -> list[Node]:
    wrapper = _nodes(some[0])
    for s in some[1:]:
        wrapper = align(wrapper, _nodes(s))
    return wrapper


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (expression), slots (paths of its text slots that hold main text) same (paths of template text on
    pages without marked elements), nodes (of the expression, where it has such slots) and fixed (numbers of its slots that hold
    template text), for every host; pages without host have ''."""
    found = materialise(pages.select(F.lit(0), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
                        .mapInArrow(_survey, "host string, kind string, what string, pages long, chars long, lo long, hi long, plo long, phi long")
                        .groupBy("host", "kind", "what").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("plo").alias("plo"), F.max("phi").alias("phi")))

    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "what"], ascending=[False, True])
        return pd.DataFrame({"host": [rows.host.iloc[0]], "what": [json.dumps(_aligned(rows.what.tolist()))], "pages": [int(rows.pages.sum())]})

    part = found.where("kind = 's'").withColumn("split", F.pmod(F.xxhash64("what"), F.lit(SPLITS))).groupBy("host", "split").applyInPandas(partial, "host string, what string, pages long")

    def whole(_key, some: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["pages", "what"], ascending=[False, True])
        wrapper = _aligned(some.what.tolist())
        known = {r.what: (int(r.pages), int(r.chars), r.lo == r.hi) for r in stats.itertuples() if r.kind == "p"}
        slots = main_paths(known) | {r.what for r in stats.itertuples() if r.kind == "m"}
        return pd.DataFrame({"host": [some.host.iloc[0]], "wrapper": [expression(wrapper)], "slots": [json.dumps(sorted(slots))], "same": [json.dumps(sorted(same_paths(known)))], "nodes": [json.dumps(wrapper)]})

    about = materialise(part.groupBy("host").cogroup(found.where("kind IN ('p', 'm')").groupBy("host")).applyInPandas(whole, "host string, wrapper string, slots string, same string, nodes string"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, f"{_name_of(shape)}/{k}", slot) for host, shape, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, slot in enumerate(matched(_nodes(nodes), _nodes(shape)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.string(), pa.string(), pa.int32()), strict=True)], ["host", "what", "slot"])

    texts = found.where("kind = 't'")
    streams = found.where("kind = 's'").select("host", "what").repartition(task_slots(pages.sparkSession), "host", "what")
    placed = streams.join(about.select("host", "nodes"), "host").mapInArrow(place, "host string, what string, slot int")
    slots = texts.join(placed, ["host", "what"]).where("slot >= 0").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), *[F.min(c).alias(c) for c in ("lo", "plo")], *[F.max(c).alias(c) for c in ("hi", "phi")])
    fixed = slots.where("pages >= 5 AND lo = hi AND plo < phi").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("slot"))).alias("fixed"))
    return materialise(about.join(fixed, "host", "left").withColumn("nodes", F.when(F.col("fixed").isNotNull(), F.col("nodes"))))


@lru_cache(1 << 10)
def _expression_slots(wrapper: str, page: tuple[Node, ...]) -> list[int]:
    return matched(_nodes(wrapper), list(page))


def extract(page: str | None, slots: frozenset[str], same: frozenset[str] = frozenset(), fixed: frozenset[int] = frozenset(), wrapper: str = "[]") -> str:
    """The texts of the page's slots that hold main text, in page order.

    These are its marked ones, else those whose paths are among `slots`. A page of another layout, which has neither, is
    judged by its own texts: without those of the paths `same`, or with them if there are no others.
    On pages without marked ones, slots that are among `fixed` in the host's expression `wrapper` give no text, unless all are.
    """
    nodes, slot_of, texts = _rows_of(page)
    where = paths(nodes)
    rows = [(where[s], t, s) for s, t in zip(slot_of, texts, strict=True) if t]
    chars: dict[str, int] = defaultdict(int)
    for p, t, _ in rows:
        if _free(p):
            chars[p] += len(t)
    marked = set(filter(_marked, chars))
    used = marked or chars.keys() & slots
    if not used:
        used = main_paths({p: (1, n, False) for p, n in chars.items() if p not in same} or {p: (1, n, False) for p, n in chars.items()})
    rows = [row for row in rows if row[0] in used]
    if fixed and not marked:
        at = _expression_slots(wrapper, tuple(nodes))
        rows = [row for row in rows if at[row[2]] not in fixed] or rows
    return "\n\n".join(t for _, t, _ in rows)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text (blocks joined by an empty line), n_chars.

    A null or empty page has an empty text. Pages whose url is null or has no host share one wrapper. Repeated rows are
    extracted one by one; other columns are ignored.
    """
    wrappers = infer_wrappers(pages).select("host", "slots", "same", "fixed", "nodes")
    size = wrappers.agg(F.sum(F.length(F.concat_ws("", *wrappers.columns)))).first()[0] or 0
    host = F.expr("translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, frozenset] = {}
        for piece in pieces(batches, "html"):
            out = []
            for page, *lists, nodes in zip(*(piece.column(k).to_pylist() for k in (2, 4, 5, 6, 7)), strict=True):
                for some in lists:
                    if some not in known:
                        known[some] = frozenset(json.loads(some or "[]"))
                out.append(extract(page, *(known[some] for some in lists), nodes or "[]"))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(F.broadcast(wrappers) if size <= SMALL else wrappers, "host", "left").select("page_id", "url", "html", "host", "slots", "same", "fixed", "nodes")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
