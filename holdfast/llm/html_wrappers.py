"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of blocks, each a text under a path of elements. Streams of one host are aligned
one after the other: what only some have becomes optional, what follows itself becomes a repeated group, and
each place holds a text slot. The wrapper says which slots of a host's pages hold the article.

Equal streams are counted before they meet, repeats already folded, so a host with many pages has few streams; these
are merged in groups of bounded size, wrappers with wrappers. Then each page is matched, and what the texts of a slot are
like (different pages, whether they differ, their length, how much of them is links) is summed by host and slot.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.sources.tables import settle

# Elements by what they do.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|canvas|object|audio|video"
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN = set("html body div center table tbody thead tfoot tr ul ol dl menu section details figure blockquote fieldset".split())
MARKS = {"article", "main"}
#: Elements whose class and id say nothing: ids of headings are made from their texts.
NAMED_FREELY = MARKS | set("p h1 h2 h3 h4 h5 h6".split())
#: Mean characters of a block below which a hint is believed.
SHORT = 200
DROPPED = set("head nav footer aside button select dialog menu".split())
#: Hints only, as are the words: what the slot is like decides.
DOUBTFUL = {"header", "form"}
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: What a new element of these ends, if it is open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
NESTS = {"ul", "ol", "dl", "table", "article", "section", "div", "blockquote"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DIGITS = re.compile(r"[0-9]+")


def region(tag: str, attrs: str, inside: bool = False) -> str:
    """"!" for an element that is none of an article's, "?" for one whose name hints at that (a menu, advert, notice, comment
    and so on), else nothing. `inside`: in a marked element, whose header is its own."""
    if tag in DROPPED:
        return "!"
    found = "?" if tag == "form" or tag == "header" and not inside else ""
    if not attrs or tag in ("html", "body"):
        return found
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return "!"
        if name == "role" and value in DROPPED_ROLES:
            found = "!"
        elif name in ("class", "id") and tag not in NAMED_FREELY and DROPPED_WORDS & set(value.split()):
            found = found or "?"
    return found


def dropped(tag: str, attrs: str) -> bool:
    """Whether an element is none of an article's, or hinted to be none."""
    return bool(region(tag, attrs))


def labelled(tag: str, attrs: str) -> str:
    """A container with its first class, without digits."""
    if tag in PLAIN and attrs:
        for name, *values in ATTRIBUTE.findall(attrs):
            if name.lower() == "class" and (words := "".join(values).lower().split()):
                return f"{tag}.{DIGITS.sub('', words[0])}".replace(">", "")
    return tag


def blocks(page: str) -> list[tuple[str, str, int]]:
    """The page's texts in order: path, text, and how many of its characters are in links.

    A path names the regions around a text (marked, dropped and hinted elements), the innermost container with a
    class and the innermost element that is no mere container. White space is one space; character references are decoded.
    """
    out: list[tuple[str, str, int]] = []
    opened: list[tuple[str, str, str]] = []
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            regions = [out_of + (label if out_of else tag) for tag, out_of, label in opened if out_of or tag in MARKS]
            within = [label for tag, out_of, label in opened if label != tag and not out_of][-1:]
            last = next((tag for tag, *_ in reversed(opened) if tag not in PLAIN), "body")
            path = ">".join(dict.fromkeys([*regions, *within, last]))
            out.append((path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    for token in TOKEN.finditer(page):
        if (text := token["text"]) is not None:
            found = html.unescape(text)
            parts.append(found)
            if links:
                linked += len(found)
            continue
        if token["raw"] is not None or token["tag"] is None:
            if token["raw"] is not None and token["raw"].lower() != "svg":
                parts.append(" ")
            continue
        tag, end = token["tag"].lower(), bool(token["end"])
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        if tag not in BLOCKS:
            continue
        flush()
        if end:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == tag:
                    del opened[k:]
                    break
                if opened[k][0] in MARKS and tag == "p":
                    break
        elif tag not in EMPTY:
            closes = ENDS.get(tag, {"p"})
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] in closes:
                    del opened[k:]
                elif opened[k][0] in NESTS and opened[k][0] != tag:
                    break
            inside = any(o[0] in MARKS for o in opened)
            opened.append((tag, region(tag, token["attrs"], inside), labelled(tag, token["attrs"])))
    flush()
    return out


def fold(paths: list[str], longest: int = 6) -> list[list]:
    """Elements [paths, optional, repeated] of a stream: what directly follows itself becomes a repeated group."""
    out: list[list] = [[[p], False, False] for p in paths]
    for width in range(1, longest + 1):
        done: list[list] = []
        k = 0
        while k < len(out):
            part, n = out[k : k + width], 1
            while len(part) == width and out[k + n * width : k + (n + 1) * width] == part:
                n += 1
            if n > 1 and not any(e[1] or e[2] for e in part):
                done.append([[p for e in part for p in e[0]], False, True])
                k += n * width
            elif n > 1 and width == 1:
                done.append([part[0][0], part[0][1], True])
                k += n
            else:
                done.append(out[k])
                k += 1
        out = done
    return out


def align(one: list[list], two: list[list]) -> list[list]:
    """The wrapper of two streams or wrappers: parts of one alone become optional, equal neighbours a repeated group."""
    a, b = ([tuple(e[0]) for e in w] for w in (one, two))
    out: list[list] = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2]] for x, y in zip(one[i:j], two[k:m])]
        else:
            out += [[e[0], True, e[2]] for e in one[i:j] + two[k:m]]
    merged: list[list] = []
    for e in out:
        if merged and merged[-1][0] == e[0]:
            merged[-1] = [e[0], merged[-1][1] and e[1], True]
        else:
            merged.append(e)
    return merged


def host_of(url: str) -> Column:
    """Host name in lower case without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def streams(pages: DataFrame) -> DataFrame:
    """Distinct folded streams (host, stream) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(h, json.dumps(fold([p for p, _, _ in blocks(page or "")]))) for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "stream"])

    return pages.select("host", "html").mapInArrow(run, "host string, stream string")


def slots(pages: DataFrame, few: int) -> DataFrame:
    """(host, slot, digest, low, high, blocks, chars, links): the texts of a slot in pages (host, html, wrapper), summed by
    batch, in up to `few` rows with a page's digest each."""
    schema = pa.schema([("host", pa.string()), ("slot", pa.string()), *((n, pa.int64()) for n in ("digest", "low", "high", "blocks", "chars", "links"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            digests: dict[tuple, set[int]] = {}
            for host, page, wrapper in zip(*(batch[c].to_pylist() for c in ("host", "html", "wrapper"))):
                digest = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
                texts: dict[str, list[int]] = {}
                for slot, _, text, linked in matched(page or "", wrapper):
                    t = texts.setdefault(slot, [0, 0, 0, 0])
                    t[0] = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), t[0]) >> 1
                    t[1:] = [t[1] + 1, t[2] + len(text), t[3] + linked]
                for slot, (mark, *more) in texts.items():
                    s = sums.setdefault((host, slot), [mark, mark, 0, 0, 0])
                    s[:] = [min(s[0], mark), max(s[1], mark), *(x + y for x, y in zip(s[2:], more))]
                    if len(seen := digests.setdefault((host, slot), set())) < few:
                        seen.add(digest)
            rows = [(*k, d, *s[:2], *([0, 0, 0] if n else s[2:])) for k, s in sums.items() for n, d in enumerate(digests[k])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return pages.select("host", "html", "wrapper").mapInArrow(run, "host string, slot string, digest bigint, low bigint, high bigint, blocks bigint, chars bigint, links bigint")


def merge_streams(found: DataFrame, crowd: int = 32) -> DataFrame:
    """One wrapper (host, stream) per host from distinct streams, merged `crowd` at a time in rounds."""

    def run(table: pa.Table) -> pa.Table:
        ordered = sorted(table["stream"].to_pylist(), key=lambda s: (len(s), s))
        wrapper = json.loads(ordered[0])
        for s in ordered[1:]:
            wrapper = align(wrapper, json.loads(s))
        return pa.table({"host": table["host"].slice(0, 1), "stream": pa.array([json.dumps(wrapper)])})

    while True:
        counts = found.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        dealt = found.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / crowd)).cast("int"))
        found = settle(dealt.groupBy("host", "part").applyInArrow(run, "host string, stream string"), "wrappers")


def wrappers(pages: DataFrame, few: int = 3, small: int = 100_000) -> DataFrame:
    """(host, wrapper): the host's regular expression and what its slots' texts are like: "c" the same on all of `few`
    different pages or more, "l" mostly links, "s" short."""
    found = settle(merge_streams(settle(streams(pages).distinct(), "streams")), "wrappers")
    bare = found.select("host", F.to_json(F.struct("stream")).alias("wrapper"))
    sums = slots(with_wrappers(pages, bare, small), few).groupBy("host", "slot").agg(
        F.count_distinct("digest").alias("pages"), (F.min("low") == F.max("high")).alias("same"), F.sum("blocks").alias("blocks"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    traits = {"c": (F.col("pages") >= few) & F.col("same"), "l": F.col("links") * 2 > F.col("chars"), "s": F.col("chars") < SHORT * F.col("blocks")}
    traits = F.concat(*(F.when(held, letter).otherwise("") for letter, held in traits.items()))
    lists = sums.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", traits))).alias("slots"))
    return found.join(lists, "host", "left").select("host", F.to_json(F.struct("stream", "slots")).alias("wrapper"))


def with_wrappers(pages: DataFrame, known: DataFrame, small: int) -> DataFrame:
    """Pages with their host's wrapper: up to `small` wrappers are sent to the pages; more are joined."""
    return pages.join(F.broadcast(known) if known.count() <= small else known, "host")


@lru_cache(maxsize=4096)
def compiled(wrapper: str) -> tuple[re.Pattern, dict[str, str], dict[str, str]]:
    """A wrapper as a regular expression over one character per path, with a group for each element; the characters;
    and the slots' traits."""
    found = json.loads(wrapper)
    elements, letters = json.loads(found["stream"]), {}
    for paths, _, _ in elements:
        for p in paths:
            letters.setdefault(p, chr(0xF0000 + len(letters)))
    times = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}
    body = "".join(f"((?:{''.join(letters[p] for p in paths)}){times[optional, many]})" for paths, optional, many in elements)
    return re.compile(body), letters, found.get("slots") or {}


def matched(page: str, wrapper: str) -> Iterator[tuple[str, str, str, int]]:
    """A page's blocks with the slot each is in: the wrapper's element and, as that may be a group, the path in it."""
    found = blocks(page)
    expression, letters, _ = compiled(wrapper)
    fit = expression.fullmatch("".join(letters.get(path, "-") for path, _, _ in found))
    if fit is None:
        raise ValueError("a page that its host's wrapper does not describe")
    for k in range(1, expression.groups + 1):
        for path, text, linked in found[max(0, fit.start(k)) : max(0, fit.end(k))]:
            yield f"{k} {path}", path, text, linked


def article(page: str, wrapper: str) -> str:
    """The texts in the article's slots of a page, one block a line.

    In pages with marked elements the article is what is marked and not dropped; in others what is not dropped, not mostly
    links and not the same on all of the host's pages, unless nothing else is left. A hint drops what is short, mostly
    links or the same on all pages (a form or header: the last two), but not where most of the page's text is.
    """
    traits = compiled(wrapper)[2]
    rows = [(path.split(">"), text, traits.get(slot, "")) for slot, path, text, _ in matched(page, wrapper)]
    rows = [r for r in rows if not any(name[0] == "!" for name in r[0])]
    marked = [r for r in rows if not MARKS.isdisjoint(r[0])]
    rows, loose = marked or rows, "" if marked else "cl"
    chars: dict[str, int] = {}
    for names, text, _ in rows:
        for name in names:
            if name[0] == "?":
                chars[name] = chars.get(name, 0) + len(text)
    half = sum(len(text) for _, text, _ in rows) / 2

    def kept(names: list[str], like: str, against: str) -> bool:
        for name in names:
            if name[0] == "?" and chars[name] <= half:
                against += "cl" if name[1:].split(".")[0] in DOUBTFUL else "cls"
        return not set(against) & set(like)

    texts = [text for names, text, like in rows if kept(names, like, loose)]
    return "\n".join(texts or [text for names, text, like in rows if kept(names, like, loose.replace("c", ""))])


def extract(pages: DataFrame, small: int = 100_000) -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none), n_chars.

    Null and empty pages have no text. Pages without a host are a host of their own. Up to `small` wrappers are sent to
    the pages; more are joined. Rows are neither merged nor dropped; other columns are not read.
    """
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    joined = with_wrappers(rows, settle(wrappers(rows, small=small), "wrappers"), small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [article(p or "", w) for p, w in zip(part["html"].to_pylist(), part["wrapper"].to_pylist())]
                counts = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    out = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, out)
