"""HTML main-text extraction by differencing pages with near URLs.

Pages are ordered by URL path within each host. Each different page is paired with its neighbours in that order, both are cut into text lines (blocks), the lines
are aligned by longest common subsequence, and lines that a pair shares are deleted as template text.

Two things differencing can't tell: an article passage that recurs on the next page from a template, and a menu that no other page has from prose. There the page's own structure
speaks. It protects: shared lines inside an article or main element stay. And it marks furniture: unshared lines in navigation, footers, forms, adverts,
notices, comments and the like go, as do those outside the article where a page has one. Each result counts the lines that either decided.

The rows of a large host are dealt out in chunks of its path order, cut at ranks that are the same however the input is partitioned; a chunk is what one
task compares, page after page, holding two pages at a time. A chunk also gets the pages beside it, which lie in others, so the cuts change no result. Texts move once.

Defined cases: null or empty html gives an empty text; a page alone on its host is compared with none; equal pages next to each other are one page of the order; null urls form
one host; elements left open end where HTML ends them; a tag that is never finished is text; attribute values of any length are markup; an empty table gives an empty
result; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayglass.llm.shared import written
from wayglass.llm.sharding import _rank_in

#: A host's pages are cut into chunks of the table's rows over CHUNKS, and of LEAST_CHUNK pages at least; so there are no more than CHUNKS cuts in all.
CHUNKS, LEAST_CHUNK = 4096, 64
#: Zones of a line. NESTED: in an article inside furniture, which counts where a page has no other article. IN_FORM: in a form, which counts where all of a page is in forms.
FURNITURE, OTHER, MAIN, NESTED, IN_FORM = range(5)
#: Bits that an alignment may hold at once; longer pairs are split (Hirschberg).
BITS_HELD = 1 << 28

#: Comments, tags with their attributes, other declarations. Quotes count only after an equals sign.
_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-z][a-z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|[!?/][^>]*>)""", re.S | re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "iframe", "textarea")}
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("head nav footer aside form menu button dialog title template noscript svg select".split())
#: Elements that are always followed to their end; others only where they change the zone.
_FOLLOWED = _FURNITURE | frozenset("article main header div section ul ol table figure search".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends an open element of these, up to the nearest of those.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dd": (frozenset("dd dt".split()), frozenset(["dl"])), "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset(["table", "tr"])), "th": (frozenset("td th".split()), frozenset(["table", "tr"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words that mark page furniture in classes and ids, and words that may stand beside them there; roles of furniture.
_MARKS = frozenset("ad ads adsbygoogle advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related share sharing sidebar social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
_BESIDE = frozenset("area bar block bottom box buttons container content count fixed form global group holder icon icons inner item items left link links list lower main outer overlay page panel posts primary replies reply right row secondary site slot small sticky stories the thread title top unit upper wrap wrapper zone".split())
#: Words that mark furniture whatever stands beside them, and as ends of longer words, unless a word says what a page has or lacks rather than what an element is.
_CLEAR = frozenset("comment comments disqus newsletter newsletters signup sidebar navbar breadcrumb breadcrumbs cookie cookies gdpr consent advert adverts advertisement advertisements adsbygoogle sponsor sponsored sponsors promo promos pagination popup masthead footer nav".split())
_ENDINGS = ("nav", "navbar", "footer", "sidebar")
_TELLING = frozenset("has have no non not with without is enable enabled disable disabled hide hides show shows".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?![\w-])(?!\s*=\s*[\"']?until-found)", re.I)
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")


def marks_furniture(name: str, in_main: bool) -> bool:
    """Whether one class or id says so: a word that is clear by itself, or words that mark furniture where all others may stand beside them. An article's header is its own."""
    words = [w.lower() for w in _PART.findall(name)]
    if any(w in _CLEAR or w.endswith(_ENDINGS) for w in words) and not _TELLING.intersection(words):
        return True
    marks = [w for w in words if w in _MARKS]
    return bool(marks) and all(w in _MARKS or w in _BESIDE or w.isdigit() for w in words) and not (in_main and set(marks) <= {"header"})


def zone_inside(tag: str, attributes: str, zone: int, in_article: bool = False) -> int:
    """The zone of what an element holds, by its tag and attributes, the zone it is in and whether an article is open. An article in an article is a reader's comment on it; hidden elements are no text."""
    values = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)] if attributes else []
    role = next((v.strip().lower() for k, v in values if k == "role"), "")
    if attributes and (any(k == "style" and _UNSHOWN.search(v) for k, v in values) or _HIDDEN.search(_QUOTED.sub("=", attributes))):
        return FURNITURE
    if tag == "main" or role == "main":
        return MAIN
    article = tag == "article" or role == "article"
    if article and in_article and zone == MAIN:
        return FURNITURE
    if zone == FURNITURE:
        return NESTED if article else FURNITURE
    if tag == "form":
        return IN_FORM if zone in (OTHER, IN_FORM) else FURNITURE
    in_main = zone in (MAIN, NESTED)
    if tag in _FURNITURE or role in _ROLES or (tag == "header" and not in_main):
        return FURNITURE
    if tag not in ("html", "body") and any(marks_furniture(name, in_main) for k, v in values if k in ("class", "id") for name in v.split()):
        return NESTED if article and not in_main else FURNITURE
    return MAIN if article and zone != NESTED else zone


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its zone."""
    html = html or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # elements followed, each with the zone around it
    open_: Counter[str] = Counter()
    zone, buffer = OTHER, []

    def flush() -> None:
        if buffer:
            line = " ".join(unescape("".join(buffer)).split())
            if line:
                out.append((line, zone))
            buffer.clear()

    def close(i: int) -> None:
        nonlocal zone
        if stack[i][1] != zone:
            flush()
        zone = stack[i][1]
        open_.subtract(t for t, _ in stack[i:])
        del stack[i:]

    def close_open(tags: frozenset[str], up_to: frozenset[str] | None) -> None:
        """End the innermost open one of these tags, unless one of up_to (None: any block) comes first."""
        if any(open_[t] > 0 for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                tag = stack[i][0]
                if tag in tags:
                    close(i)
                    return
                if tag in up_to if up_to is not None else tag not in _INLINE:
                    return

    at, end = 0, html.rfind(">") + 1  # no markup ends after the last >
    while m := _MARKUP.search(html, at, end):
        buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            flush()
        if m[1]:
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in _RAW:
            done = _RAW[tag].search(html, at)
            at = done.start() if done else len(html)
            continue
        if tag in _CLOSES_P:
            close_open(frozenset(["p"]), None)
        if tag in _ENDS:
            close_open(*_ENDS[tag])
        if tag in _VOID or (m[3].endswith("/") and tag == "svg"):
            continue
        inner = zone_inside(tag, m[3], zone, open_["article"] > 0)
        if inner != zone:
            flush()
        if inner != zone or tag in _FOLLOWED or open_[tag] > 0:
            stack.append((tag, zone))
            open_[tag] += 1
            zone = inner
    buffer.append(html[at:].split("<!--", 1)[0])
    flush()
    zones = {z for _, z in out}
    settled = {NESTED: MAIN if MAIN not in zones else FURNITURE, IN_FORM: FURNITURE if zones & {MAIN, OTHER, NESTED} else OTHER}
    return [(x, settled.get(z, z)) for x, z in out]


def _rows_of(a: list[int], masks: dict[int, int], m: int) -> Iterator[int]:
    """After each element of a, the numbers whose zero bits are the steps of the LCS length along b (bit-parallel)."""
    full = (1 << m) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[int]) -> dict[int, int]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out = {}
    for x, at in places.items():
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS lengths of a with each prefix of b."""
    last = 0
    for last in _rows_of(a, _masks(b), len(b)):
        pass
    if not a:
        return np.zeros(len(b) + 1, np.int64)
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a: list[int], b: list[int], i0: int, j0: int, out: list[tuple[int, int]]) -> None:
    """Places of a longest common subsequence of a and b, shifted by i0 and j0."""
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out += [(i0 + k, j0 + k) for k in range(n)]
    a, b, i0, j0 = a[n:], b[n:], i0 + n, j0 + n
    n = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    out += [(i0 + len(a) - k, j0 + len(b) - k) for k in range(1, n + 1)]
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return
    if len(a) * len(b) > BITS_HELD and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        _align(a[:half], b[:cut], i0, j0, out)
        _align(a[half:], b[cut:], i0 + half, j0 + cut, out)
        return
    rows = list(_rows_of(a, _masks(b), len(b)))
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:  # else the step was there before a[i]
                j -= 1
                out.append((i0 + i, j0 + j))


def shared_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in a and b of a longest common subsequence."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in lines] for lines in (a, b))
    both = set(x) & set(y)  # lines of one page alone are in no common subsequence
    at, bt = [i for i, v in enumerate(x) if v in both], [j for j, v in enumerate(y) if v in both]
    out: list[tuple[int, int]] = []
    _align([x[i] for i in at], [y[j] for j in bt], 0, 0, out)
    return {at[i] for i, _ in out}, {bt[j] for _, j in out}


def main_text(lines: list[str], zones: list[int], shared: set[int]) -> tuple[str, int, int, int]:
    """The text, and how many lines differencing deleted, structure deleted, and structure protected."""
    has_main = MAIN in zones
    kept, counts = [], [0, 0, 0]
    for i, (line, zone) in enumerate(zip(lines, zones, strict=True)):
        if i in shared and zone != MAIN:
            counts[0] += 1
        elif zone == FURNITURE or (has_main and zone != MAIN):
            counts[1] += 1
        else:
            counts[2] += i in shared
            kept.append(line)
    return "\n".join(kept), *counts


def placed(pages: DataFrame) -> DataFrame:
    """page_id, none (no page_id), url, html, host, path and tie of each row; (path, tie) is the order within a host."""
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("none"), "url",
        F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "(/|\\.html?)$", "").alias("path"),
        F.xxhash64("page_id", "url").alias("tie"), "html",
    )


def chunk_starts(rows: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """For each host with more pages than a chunk holds, the places in its order at which chunks start: CHUNKS at most in all."""
    light = rows.select("host", "path", "tie")
    hosts = written(light.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(LEAST_CHUNK, -(-total // CHUNKS))
    large = hosts.where(F.col("n") > size).select("host")  # CHUNKS rows at most
    own = light.join(F.broadcast(large), "host", "left_semi")
    dealt = written(own.repartitionByRange("host", "path", "tie").withColumn("range", F.spark_partition_id()), "places")
    ranked = _rank_in(dealt, ["host"], "range", ["path", "tie"], "rank")
    out: dict[str, list[tuple[str, int]]] = {}
    for r in ranked.where((F.col("rank") > 0) & (F.col("rank") % size == 0)).select("host", "path", "tie").collect():
        out.setdefault(r["host"], []).append((r["path"], r["tie"]))
    return {h: sorted(v) for h, v in out.items()}


def beside(rows: DataFrame, chunk_of) -> dict[tuple[str, str, int], list[int]]:
    """Of hosts cut into chunks, the places of the pages that chunks need from others, and the chunks: the page before a chunk's first and the one after its last, the next that differs.

    Reads digests of the lines; what comes to the driver is a row a chunk.
    """

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chunk = chunk_of(f)
            cut = [c >= 0 for c in chunk]
            f = f.assign(chunk=chunk)[cut]
            yield f.drop(columns="html").assign(digest=[md5(repr(text_lines(h)).encode("utf-8", "surrogatepass")).hexdigest() for h in f["html"]])

    light = rows.select("host", "path", "tie", "html").mapInPandas(digests, "host string, path string, tie long, chunk int, digest string")
    order = Window.partitionBy("host", "chunk").orderBy("path", "tie")
    row, apart = F.struct("path", "tie", "digest"), lambda f: f("digest").over(order) != F.col("digest")
    runs = light.select("host", "chunk", row.alias("row"), F.when(apart(F.lag), row).alias("starts"), F.when(apart(F.lead), row).alias("ends"))
    chunks: dict[str, list] = {}
    found = runs.groupBy("host", "chunk").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.min("starts").alias("second"), F.max("ends").alias("last_but_one"))
    for r in sorted(found.collect(), key=lambda r: (r["host"], r["chunk"])):  # 2 * CHUNKS rows at most
        chunks.setdefault(r["host"], []).append(r)
    out: dict[tuple[str, str, int], list[int]] = {}
    for host, own in chunks.items():
        for line, near, far, other in ((own, "first", "last", "last_but_one"), (own[::-1], "last", "first", "second")):
            known = None  # the neighbour of the chunk before in this line
            for before, r in zip([None, *line], line, strict=False):
                if before is not None and before[far]["digest"] != r[near]["digest"]:
                    known = before[far]
                elif before is not None and before[other] is not None:
                    known = before[other]
                if known is not None:  # a chunk of equal pages hands its own neighbour on
                    out.setdefault((host, known["path"], known["tie"]), []).append(r["chunk"])
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row, and n_lines, n_by_difference, n_by_structure, n_protected (shared lines that stay)."""
    rows = placed(pages)
    cuts = chunk_starts(rows)
    starts = rows.sparkSession.sparkContext.broadcast(cuts)

    def chunks_of(f: pd.DataFrame, whole: int = -1) -> list[int]:
        return [bisect_right(starts.value[h], (p, t)) if h in starts.value else whole for h, p, t in zip(f["host"], f["path"], f["tie"], strict=True)]

    lent = rows.sparkSession.sparkContext.broadcast(beside(rows, chunks_of) if cuts else {})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [text_lines(h) for h in f["html"]]
            out = f.drop(columns="html").assign(chunk=chunks_of(f, 0), shown=True, lines=[[x for x, _ in p] for p in found], zones=[[z for _, z in p] for p in found])
            yield out
            asked = [lent.value.get(place, []) for place in zip(f["host"], f["path"], f["tie"], strict=True)]
            if any(asked):  # pages at the ends of chunks go to the chunks beside them too, for comparison only
                yield out.assign(chunk=asked, shown=False)[[bool(x) for x in asked]].explode("chunk").astype({"chunk": "int32"})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "text", "n_chars", "n_lines", "n_by_difference", "n_by_structure", "n_protected"]
        key, page = None, None  # page: lines, zones, shared lines, rows of equal pages

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).assign(page_id=pd.array([r[0] for r in rows], dtype="Int64"))

        def done() -> list[tuple]:
            if page is None or not page[3]:
                return []
            text, *counts = main_text(page[0], page[1], page[2])
            return [(None if none else page_id, url, text, len(text), len(page[0]), *counts) for page_id, none, url in page[3]]

        for f in frames:
            out = []
            for page_id, none, url, host, chunk, shown, lines, zones in zip(f["page_id"], f["none"], f["url"], f["host"], f["chunk"], f["shown"], f["lines"], f["zones"], strict=True):
                row = [(page_id, none, url)] if shown else []
                lines, zones = list(lines), list(zones)
                if (host, chunk) == key and page[0] == lines and page[1] == zones:
                    page[3].extend(row)
                    continue
                fresh = (lines, zones, set(), row)
                if (host, chunk) == key:
                    before, after = shared_lines(page[0], lines)
                    page[2].update(before)
                    fresh[2].update(after)
                out += done()
                key, page = (host, chunk), fresh
            if out:
                yield table(out)
        if page is not None:
            yield table(done())

    lines = rows.mapInPandas(cut, "page_id long, none boolean, url string, host string, path string, tie long, chunk int, shown boolean, lines array<string>, zones array<int>")
    dealt = lines.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "path", "tie")
    return dealt.mapInPandas(compare, "page_id long, url string, text string, n_chars long, n_lines int, n_by_difference int, n_by_structure int, n_protected int")
