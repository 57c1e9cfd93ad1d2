"""HTML extraction with a host suffix array.

A page is read once, tag by tag, into blocks, each in a zone: article (inside <article>, <main> or role=main), marked (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, as their tags, roles and class names tell), or open (anything
else). Scripts, styles, comments and markup are no blocks, and marked blocks go. The others are written, a row a page.

The token streams of a host's blocks are joined, and a suffix array over them (sorted to a depth of RUN tokens by prefix doubling)
finds substrings of RUN tokens or more, and whole short blocks, with the number of distinct pages that have them (pages whose blocks
are equal are one). What repeats is boilerplate, covers its tokens, and the unique runs are the text in the page's order: in open
blocks what PAGES pages have; in article blocks what PAGES pages and SHARE per cent of the host's pages have, as an article
may quote what another one has, and only a template is on most pages.

Substrings of RUN tokens are not counted all. Of each SEED-gram window of that length the one with the least hash is an anchor; equal
substrings have equal anchors, so blocks whose anchors are on too few pages hold no boilerplate, and do not go to the suffix
arrays. Anchors are counted by range of key, sorted and packed; copies of a page count once a task there, which can only let more
blocks through. A large host's blocks are dealt over many tasks, PART pages or PART_CHARS characters each; a task gives the pages of
each substring among its own, and sums over tasks are exact, as pages with equal blocks are in one. Anchors, and then the substrings
found, set bits of a map of fixed size; pages without any of its bits need no join.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import scratch, small_batches, text_of, written
from .katz import by_range, pack, pack_keys, unpack, unpack_keys
from .kernel import _PLACE, BATCH_BYTES, U, Words, mix, words

#: Tokens of a long substring, and of the grams among which its anchor is; distinct pages of a host that make it boilerplate, and
#: for articles per cent of the host's pages; pages of a host in a task, about, and characters of their blocks; bits of the map.
RUN, SEED, PAGES, SHARE, PART, PART_CHARS, BITS = 8, 4, 3, 50, 500, 8_000_000, 1 << 24
#: Anchors that a task packs at a time, and that a range of keys holds, about.
FLUSH, RANGE = 1_500_000, 1_000_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
#: Elements of the HTML standard by what they are here.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_OUT = frozenset("nav header footer aside form button select dialog menu template noscript head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Words in class names and ids of what is no article.
_MARKS = frozenset("ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that may stand beside them in a name (ad-slot, related-articles), any other word makes the name tell of
#: something else (related-work, has-sidebar).
_BESIDE = frozenset("area articles bar block bottom box btn button buttons center container content form group header holder icons inner item items left link links list main media outer panel posts primary right secondary section site slot stories thread top unit wrap wrapper".split())
_ROLES = frozenset("banner complementary contentinfo dialog alert form navigation search menu menubar toolbar".split())
OPEN, ARTICLE, MARKED = 0, 1, 2


def _marks(name: str) -> bool:
    """Whether a class name or id tells of what is no article."""
    parts = {p for p in _NAME.findall(name) if not p.isdigit()}
    return bool(parts & _MARKS) and parts <= _MARKS | _BESIDE


def _kind(name: str, attributes: str) -> int:
    """The zone that an element opens, OPEN for that around it."""
    names, role = set(), ""
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                role = value
            else:
                names.update(value.split())
    if name in _OUT or role in _ROLES or (name not in ("html", "body") and any(map(_marks, names))):
        return MARKED
    return ARTICLE if name in ("article", "main") or role == "main" else OPEN


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order. Unclosed elements end with the one around them; an end tag of nothing open is
    passed over. Marked zones hold also within articles; an article within a marked zone is marked."""
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = []
    zone, pieces, at = OPEN, [], 0
    names: Counter[str] = Counter()  # of open_
    last = page.rfind(">") + 1

    def end_from(i: int) -> int:
        """End the open elements from i on; return the zone around them."""
        around = open_[i][1]
        names.subtract(n for n, _ in open_[i:])
        del open_[i:]
        return around

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((zone, text))
            pieces.clear()

    while True:
        m = _TAG.search(page, at, last)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            elif m[0].startswith("<![CDATA["):
                pieces.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m[1] or m[4]:  # an end
            if name in _BLOCK or name in _OUT:
                flush()
            if names[name] > 0:
                i = next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name)
                if open_[i][1] != zone:
                    flush()
                zone = end_from(i)
            continue
        if name in _BLOCK or name in _OUT:
            flush()
        elif name == "br":
            pieces.append(" ")
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            continue
        attributes = m[3] or m[6] or ""
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # a new one ends the last
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    zone = end_from(i)
                    break
                if open_[i][0] in _BLOCK:
                    break
        kind = _kind(name, attributes)
        names[name] += 1
        if zone != MARKED and kind != OPEN and kind != zone:
            flush()
            open_.append((name, zone))
            zone = kind
        else:
            open_.append((name, zone))
    flush()
    return out


def block_runs(texts: list[str], depth: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Key, first token and number of tokens of each substring of `depth` tokens of a block, and of each shorter whole block;
    and the blocks' tokens. A substring has the same key in all tasks."""
    raw = [t.encode() for t in texts]
    w = words(np.frombuffer(b"".join(raw) or b" ", np.uint8), np.cumsum([0, *map(len, raw)]), lower=False)
    runs, at = w.runs(depth)
    short = np.flatnonzero((w.counts > 0) & (w.counts < depth))
    first, n = w.first[short], w.counts[short]
    h = np.zeros(len(short), U)
    for k in range(depth - 1):
        has = n > k
        h[has] += w.hash[first[has] + k] * _PLACE[k]
    whole = mix(mix(h) + n.astype(U))
    return np.concatenate([runs, whole]).view(np.int64), np.concatenate([at, first]), np.concatenate([np.full(len(at), depth), n]), w


def anchors(w: Words, depth: int = RUN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the substrings of `depth` tokens, with repeats, and the block of each: of the grams of `seed` tokens in a
    substring, the one with the least hash."""
    grams, at = w.runs(seed)
    wide = depth - seed  # a substring has wide + 1 grams
    n = len(grams) - wide
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for k in range(1, wide + 1):
        np.minimum(least, grams[k : k + n], out=least)
    of = w.of[at]
    same = of[:n] == of[wide : wide + n]
    return least[same].view(np.int64), of[:n][same]


def counted(texts: list[str], page: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """texts: blocks; page: the page of each. Returns the key of each substring of `depth` tokens and of each shorter whole block,
    and the pages with it. Tokens of all blocks are joined with a separator after each; ranks of suffixes double their depth until
    they tell `depth` tokens apart, and neighbours of equal rank in the suffix array have the same substring."""
    keys, at, n, w = block_runs(texts, depth)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(w.hash)) + w.of  # of a token, where each block before has a separator
    rank = np.zeros(len(w.hash) + len(texts), np.int64)
    rank[place] = np.unique(w.hash, return_inverse=True)[1] + 1
    room = np.zeros(len(rank), np.int64)
    room[place] = w.first[w.of + 1] - np.arange(len(w.hash))
    first, width = rank, 1
    while width < depth:
        step = min(width, depth - width)
        # past a block's end only the separator counts, so that suffixes of blocks compare alike everywhere
        ahead = np.where(room >= width, np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)], 0)
        rank = np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)[1] + 1
        rank[first == 0] = 0
        width += step
    own, whole, of = rank[place[at]], n < depth, w.of[at]
    order = np.lexsort((whole, own))
    new = np.concatenate([[True], (np.diff(own[order]) != 0) | (np.diff(whole[order]) != 0)])
    group, pages = np.cumsum(new) - 1, int(page.max()) + 1
    met = np.unique(group * pages + page[of[order]]) // pages
    return keys[order][new], np.bincount(met, minlength=int(group[-1]) + 1)


def repeated(streams: list[list[list[str]]], depth: int = RUN) -> dict[int, int]:
    """streams: for each page its blocks' tokens. Key of each substring -> pages with it."""
    texts = [" ".join(b) for one in streams for b in one]
    page = np.repeat(np.arange(len(streams)), [len(one) for one in streams])
    keys, pages = counted(texts, page, depth)
    return dict(zip(keys.tolist(), pages.tolist(), strict=True))


def keys_of(tokens: list[str], depth: int = RUN) -> list[tuple[int, int, int]]:
    """(key, from, to) of a block's substrings, as repeated() names them."""
    keys, at, n, _ = block_runs([" ".join(tokens)], depth)
    return list(zip(keys.tolist(), at.tolist(), (at + n).tolist(), strict=True))


def unique_runs(found: list[tuple[int, str]], common: np.ndarray, in_articles: np.ndarray) -> tuple[list[str], int]:
    """A page's blocks without the tokens that substrings cover, and the number of those: substrings of common in open blocks,
    those of in_articles in article blocks. Blocks of which nothing is left go."""
    keys, at, n, w = block_runs([t for _, t in found])
    article = np.array([z == ARTICLE for z, _ in found], bool)[w.of[at]]
    hit = np.where(article, np.isin(keys, in_articles), np.isin(keys, common))
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, (at + n)[hit], -1)
    gone = np.cumsum(cover[:-1]) > 0
    left = [" ".join(t for t, g in zip(t.split(" "), gone[a:b], strict=True) if not g) for (_, t), a, b in zip(found, w.first[:-1], w.first[1:], strict=True)]
    return [t for t in left if t], int(gone.sum())


def joined(found: list[tuple[int, str]]) -> str:
    return "\n".join(f"{z}{t}" for z, t in found)  # blocks have no line ends


def parted(data: str) -> list[tuple[int, str]]:
    return [(int(x[0]), x[1:]) for x in data.split("\n")] if data else []


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def parsed(rows: DataFrame) -> DataFrame:
    """rows: (page_id, url, host, place, html) -> (page_id, url, host: its hash, place, key: of the blocks, blocks)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for x in batch.column(4).to_pylist():
                out.append(joined([(z, t) for z, t in blocks(x) if z != MARKED]))
                keys.append(xxhash.xxh3_64_intdigest(out[-1]) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["page_id", "url", "host", "place", "key", "blocks"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url", "host", "place")]
    return rows.select("page_id", "url", "host", "place", "html").mapInArrow(read, ", ".join([*kinds, "key bigint, blocks string"]))


def _pages(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[tuple[int, str]]]]]:
    """(from row, to row, pages' blocks) for stretches of a batch of about BATCH_BYTES of text."""
    start, size, pages = 0, 0, []
    for i, data in enumerate(batch.column(column).to_pylist()):
        pages.append(parted(data))
        size += sum(len(t) for _, t in pages[-1])
        if size >= BATCH_BYTES:
            yield start, i + 1, pages
            start, size, pages = i + 1, 0, []
    if pages:
        yield start, batch.num_rows, pages


def _keys(pages: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and keys of short whole blocks, and the block of each, numbered over all pages."""
    keys, at, n, w = block_runs([t for one in pages for _, t in one])
    short = n < RUN
    found, of = anchors(w)
    return np.concatenate([found, keys[short]]), np.concatenate([of, w.of[at[short]]])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, str]]]]]:
    """Stretches of a task's rows (host, key, blocks) and their blocks, of pages with equal blocks the first."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if at not in seen:
                seen.add(at)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int64()))
        for a, b, pages in _pages(batch, 2):
            yield batch.slice(a, b - a), pages


def _hosts(rows: pa.RecordBatch, page: np.ndarray) -> np.ndarray:
    return rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)[page]


def hot_anchors(table: DataFrame, hosts: DataFrame) -> DataFrame:
    """(anchor): mixed with their host, those that are on as many pages as boilerplate is, or seem to be as copies of a page in several
    tasks count in each. hosts: (host, pages)."""
    ranges = max(1, ceil((table.agg(F.sum(F.length("blocks"))).first()[0] or 0) / (18 * RANGE)))  # an anchor for some 18 characters

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, host, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            names, of = np.unique(host[order][begin], return_inverse=True)
            n, m, keys = np.add.reduceat(n[order], begin), np.add.reduceat(m[order], begin), keys[begin]
            for q, a, b in by_range(keys, ranges):
                own, at = np.unique(of[a:b], return_inverse=True)
                parts = (pack_keys(keys[a:b]), pack(names[own]), *(pack(x.astype(np.int32)) for x in (at, n[a:b], m[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["range", "keys", "hosts", "host", "n", "m"])
            held.clear()

        for rows, pages in _once(batches):
            keys, of = _keys(pages)
            if not len(keys):
                continue
            page = np.repeat(np.arange(len(pages)), [len(one) for one in pages])[of]
            open_ = np.array([z == OPEN for one in pages for z, _ in one], bool)[of]
            mixed = mix(keys.view(U) ^ mix(_hosts(rows, page)))
            order = np.lexsort((open_, page, mixed))  # of a key on a page the last row is open if any is
            last = order[np.append((mixed[order][1:] != mixed[order][:-1]) | (np.diff(page[order]) != 0), True)]
            held.append((mixed[last], _hosts(rows, page[last]), np.ones(len(last), np.int64), open_[last].astype(np.int64)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from out()
        if held:
            yield from out()

    def add(data: pa.Table) -> pa.Table:
        rows = data.to_pylist()
        keys = np.concatenate([unpack_keys(r["keys"]) for r in rows])
        known, first, at = np.unique(keys, return_index=True, return_inverse=True)
        n, m = (np.bincount(at, weights=np.concatenate([unpack(r[c], np.int32) for r in rows])).astype(np.int64) for c in "nm")
        host = np.concatenate([unpack(r["hosts"], U)[unpack(r["host"], np.int32)] for r in rows])[first]
        use = n >= PAGES
        return pa.table({"host": host[use].view(np.int64), "anchor": known[use].view(np.int64), "n": n[use], "m": m[use]})

    sent = table.select("host", "key", "blocks").mapInArrow(send, "range bigint, keys binary, hosts binary, host binary, n binary, m binary")
    counts = sent.groupBy("range").applyInArrow(add, "host bigint, anchor bigint, n bigint, m bigint")
    return counts.join(hosts, "host").where((F.col("m") > 0) | (100 * F.col("n") >= SHARE * F.col("pages"))).select("anchor")


def host_boilerplate(table: DataFrame) -> DataFrame:
    """(host, run, in_articles): substrings that PAGES or more distinct pages of the host have, and whether so many have them as makes
    them boilerplate in articles too. table: of parsed()."""
    distinct = table.groupBy("host", "key").agg(F.lit(1).alias("one"))
    hosts = written(distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "html-hosts")
    bits = bit_map(hot_anchors(table, hosts), "anchor")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in _once(batches):
            keys, of = _keys(pages)
            page = np.repeat(np.arange(len(pages)), [len(one) for one in pages])
            hot = np.zeros(len(page), bool)
            hot[of[in_map(bits, mix(keys.view(U) ^ mix(_hosts(rows, page[of]))).view(np.int64))]] = True
            flat = [x for one in pages for x in one]
            found: dict[int, list[tuple[int, str]]] = {}
            for i in np.flatnonzero(hot).tolist():
                found.setdefault(int(page[i]), []).append(flat[i])
            at = pa.array(list(found), pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(i).take(at) for i in (0, 1)), pa.array([joined(x) for x in found.values()], pa.string())], names=["host", "key", "blocks"])

    def suffix_array(data: pa.Table) -> pa.Table:
        texts, page = [], []
        once = dict(zip(data.column("key").to_pylist(), data.column("blocks").to_pylist(), strict=True))
        for i, raw in enumerate(once.values()):
            own = [t for _, t in parted(raw)]
            texts += own
            page += [i] * len(own)
        run, n = counted(texts, np.array(page, np.int64))
        use = n >= (PAGES if data.column("parts")[0].as_py() == 1 else 1)
        return pa.table({"host": pa.array([data.column("host")[0].as_py()] * int(use.sum()), pa.int64()), "run": run[use], "n": n[use].astype(np.int64)})

    found = written(table.select("host", "key", "blocks").mapInArrow(candidates, "host bigint, key bigint, blocks string"), "html-candidates", "zstd")
    sizes = found.groupBy("host").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum(F.length("blocks")) / PART_CHARS)).alias("parts"))
    dealt = found.join(written(sizes, "html-sizes"), "host").withColumn("part", F.pmod("key", F.col("parts")))
    counts = dealt.select("host", "part", "parts", "key", "blocks").groupBy("host", "part").applyInArrow(suffix_array, "host bigint, run bigint, n bigint")
    counts = counts.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES)
    return counts.join(hosts, "host").select("host", "run", (100 * F.col("n") >= SHARE * F.col("pages")).alias("in_articles"))


def bit_map(table: DataFrame, name: str) -> np.ndarray:
    """A byte for each eight of BITS bits, set where a value of the column has its place."""
    slot = F.pmod(name, F.lit(BITS))
    set_ = table.groupBy(F.shiftright(slot, 3).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod({name}, {BITS}L) & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys % BITS
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text (blocks joined by a line end; empty if none), n_removed (tokens of
    article and open blocks taken out as boilerplate of the host).

    Null HTML counts as empty; pages with a null URL, or one without a host, are of one host of their own; repeats and nulls
    of page_id stay as they are; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    host = F.xxhash64(F.lower(F.regexp_extract(text_of(url_col), _HOST, 1)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.monotonically_increasing_id().alias("place"), text_of(html_col).alias("html"))
    table = written(parsed(rows), "html-blocks", "zstd")
    with scratch(pages.sparkSession) as keep:
        common = keep(written(host_boilerplate(table), "html-common"))
    bits = bit_map(common, "run")
    kinds = ", ".join(f"{c} {pages.schema[s].dataType.simpleString()}" for c, s in (("page_id", id_col), ("url", url_col)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _pages(batch, 4):
                keys, at, _, w = block_runs([t for one in found for _, t in one])
                page = np.repeat(np.arange(len(found)), [len(one) for one in found])[w.of[at]]
                met = in_map(bits, keys)
                runs: dict[int, set[int]] = {}
                for i, k in zip(page[met].tolist(), keys[met].tolist(), strict=True):
                    runs.setdefault(i, set()).add(k)
                texts = [None if i in runs else "\n".join(t for _, t in one) for i, one in enumerate(found)]
                data = batch.column(4).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(texts, pa.string()), pa.array([d if i in runs else None for i, d in enumerate(data)], pa.string()), pa.array([sorted(runs[i]) if i in runs else None for i in range(len(found))], pa.list_(pa.int64()))], names=["page_id", "url", "host", "place", "text", "blocks", "runs"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [unique_runs(parted(data), *(np.array(r or (), np.int64) for r in runs)) for data, *runs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["\n".join(t) for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["page_id", "url", "text", "n_removed"])

    texts = table.select("page_id", "url", "host", "place", "blocks").mapInArrow(read, f"{kinds}, host bigint, place bigint, text string, blocks string, runs array<bigint>")
    if common.isEmpty():
        return texts.select("page_id", "url", "text", F.lit(0).cast("long").alias("n_removed"))
    done = texts.where("blocks IS NULL").select("page_id", "url", "text", F.lit(0).cast("long").alias("n_removed"))
    # pages with a bit of the map: their own substrings meet the host's table, and the page takes away what is in it
    rest = written(texts.where("blocks IS NOT NULL").select("page_id", "url", "host", "place", "blocks", "runs"), "html-open")
    own = rest.select("host", "place", F.explode("runs").alias("run"))
    hits = own.join(common, ["host", "run"]).groupBy("place").agg(F.collect_list("run").alias("common"), F.collect_list(F.when(F.col("in_articles"), F.col("run"))).alias("in_articles"))
    cleaned = rest.select("place", "page_id", "url", "blocks").join(hits, "place", "left").select("page_id", "url", "blocks", "common", "in_articles").mapInArrow(without, f"{kinds}, text string, n_removed bigint")
    return done.unionByName(cleaned)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
