"""Main text of web pages: structure, and suffix arrays over the token streams of each host.

A page's markup settles what is its article and what is navigation, notice, advert or script. What is outside of the
article goes, as far as it is known, into the page's token stream. Streams of a host are concatenated, a suffix array
finds the substrings of RUN tokens or more, and those on enough distinct pages of the host (copies are one page) cover
their tokens: on the square root of the host's pages, three at least. On pages whose markup names no article, a block
that is covered from end to end is boilerplate and goes; a block with anything of its own stays whole, so a quotation,
a common phrase or a sentence that two pages share takes nothing away.
Blocks of a marked article go where substrings on half of the host's distinct articles, five at least, cover them from
end to end: lines that the host puts into its articles. Paragraphs that fewer share are theirs, and an article of which
this would take more than half is a near copy of others and stays whole. Only blocks whose first RUN tokens begin a block
on so many articles can be covered, so only these enter the suffix arrays.
Large hosts are cut into shards of distinct pages with a suffix array each; the pages of a substring are summed over
the shards.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import released, shuffle_parts, stage, table

RUN = 6
MIN_PAGES = 3
MIN_ARTICLES = 5
SHARD_TOKENS = 50_000

RAW = "script|style|textarea|title|noscript|template|iframe|noframes|noembed|xmp|svg|math|object|canvas|audio|video|select"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())
CHROME_TAGS = frozenset("head nav header footer aside form button menu dialog datalist fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription share sharing social comment comments commentlist respond "
    "replies reply disqus discussion related recommended recommendations widget toolbar pagination pager login signup "
    "signin search skip complementary contentinfo dialog search-form tags byline-ad".split()
)
MAIN_WORDS = frozenset(
    "article articlebody article-body article-content article-text content main main-content maincontent post post-body "
    "post-content entry entry-content story story-body body-text page-content".split()
)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def _chrome(names: list[str]) -> bool:
    """A class or id that is a boilerplate word, or starts or ends with one; has-sidebar and the like only say what
    else is on the page."""
    for name in names:
        words = re.split(r"[-_]+", name)
        if words[0] in ("has", "with", "no", "is", "without"):
            continue
        if name in CHROME_WORDS or words[0] in CHROME_WORDS or words[-1] in CHROME_WORDS:
            return True
    return False


def _role(tag: str, attrs: str) -> str:
    """What an element is by its tag and attributes: chrome, article, main, hint, or nothing."""
    if tag in CHROME_TAGS:
        return "chrome"
    names, role = [], ""
    for m in ATTR.finditer(attrs) if attrs and tag not in ("html", "body") else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "chrome"
        if key == "role":
            role = value
        elif key != "style":
            names += value.split()
    if role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
        return "chrome"
    if tag == "article":
        return "chrome" if any(n.split("-")[0] in ("comment", "comments", "ad", "advert") for n in names) else "article"
    if tag == "main" or role == "main":
        return "main"
    if any(n in MAIN_WORDS for n in names):
        return "hint"
    return "chrome" if names and _chrome(names) else ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(region, text) of the page's text blocks in order; region is chrome, article, main, hint or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    depth = {"chrome": 0, "article": 0, "main": 0, "hint": 0}
    parts: list[str] = []
    region = "open"

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((region, text))
        parts.clear()

    def close_to(index: int) -> None:
        for _, role in stack[index:]:
            if role:
                depth[role] -= 1
        del stack[index:]

    def here() -> str:
        return next((name for name in ("chrome", "article", "main", "hint") if depth[name]), "open")

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(role for _, role in stack[i:]):
                        flush()
                    close_to(i)
                    break
        elif tag not in VOID:
            if tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or tag in CLOSED_BY_SAME and stack[i][0] == tag:
                        close_to(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            role = _role(tag, m["attrs"])
            if role:
                flush()
                depth[role] += 1
            if not m["attrs"].endswith("/") or role in ("article", "main"):
                stack.append((tag, role))
            elif role:
                depth[role] -= 1
        region = here()
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def read_page(page: str | None) -> tuple[str | None, list[int], list[str], list[bool], list[bool]]:
    """(text, sizes, stream, kept, starts): the text of the article that the markup names, else None, and the tokens of
    each of its blocks; the tokens outside of it; for an unsettled page which of them may be kept, and which start a
    block."""
    found = blocks(page or "")
    regions = {r for r, _ in found}
    best = next((r for r in ("article", "main", "hint") if r in regions), None)
    main = [t for r, t in found if r == best] if best else []
    text = " ".join(main) if best else None
    if not best and "open" not in regions:
        text = ""
    stream, kept, starts = [], [], []
    for region, block in found:
        if region != best:
            tokens = block.split(" ")
            stream += tokens
            kept += [region == "open"] * len(tokens)
            starts += [True] + [False] * (len(tokens) - 1)
    return text, [t.count(" ") + 1 for t in main], stream, kept, starts


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _keys(host: str, page: str | None) -> tuple[int, int]:
    """128 bits that stand for the page's content on its host: copies are one page."""
    data = f"{host}\n{page or ''}".encode("utf-8", "surrogatepass")
    return tuple(xxhash.xxh64_intdigest(data, seed) - (1 << 63) for seed in (1, 2))


def _cut(text: str, sizes: bytes) -> list[list[str]]:
    """The tokens of each block of an article."""
    ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
    words = text.split(" ")
    return [words[a:b] for a, b in zip([0, *ends], ends)]


def _head(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(words[:RUN]).encode("utf-8", "surrogatepass"), 3) - (1 << 63)


def _read(pages: DataFrame) -> DataFrame:
    """Per page, in one parse: text where the markup settles it, with the article's key, block sizes and heads of blocks;
    else, or beside it, the key and stream of its host."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                text, sizes, stream, kept, starts = read_page(page)
                host = host_of(url)
                mask = np.packbits([kept, starts], axis=1).tobytes() if text is None else None
                joined = " ".join(stream) if stream else None
                cuts = np.array(sizes, np.int32).tobytes() if sizes else None
                article = (*_keys(host, text), cuts, list({_head(b) for b in _cut(text, cuts) if len(b) >= RUN})) if sizes else (None,) * 4
                rows.append((page_id, url, text, host, *_keys(host, page), len(stream), joined, mask, *article))
            out = pd.DataFrame(rows, columns=["page_id", "url", "text", "host", "k1", "k2", "n", "stream", "kept", "a1", "a2", "cuts", "heads"])
            for k, name in ((9, "a1"), (10, "a2")):
                out[name] = pd.array([r[k] for r in rows], "Int64")
            out["page_id"] = batch["page_id"].astype("Int64").to_numpy()
            yield out

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = ("page_id long, url string, text string, host string, k1 long, k2 long, n long, stream string, kept binary, "
              "a1 long, a2 long, cuts binary, heads array<long>")
    return own.mapInPandas(parse, schema)


def suffix_blocks(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the tokens by their first RUN tokens, and the block of each entry: suffixes of one block
    share RUN tokens or more. A suffix that leaves its page within RUN tokens is a block of its own."""
    n, span = len(tokens), 1
    rank = tokens.astype(np.int64)
    while True:
        whole = span >= RUN
        step = min(span, RUN - span)
        if not whole:
            after = np.concatenate((rank[step:], np.full(min(step, n), -1)))[:n]
            order = np.lexsort((after, rank))
            change = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(change)))
            span += step
            continue
        last = np.minimum(np.arange(n) + RUN - 1, n - 1)
        inside = (page[last] == page) & (np.arange(n) + RUN <= n)
        order = np.lexsort((~inside, rank))  # those that leave their page last among equals
        entry = rank[order]
        split = np.concatenate(([True], (entry[1:] != entry[:-1])))
        single = ~inside[order]
        split |= single
        split[1:] |= single[:-1]
        return order, np.cumsum(split) - 1


def _covered_in(host: str, rows: list) -> pd.DataFrame:
    """Of a shard of a host whose rows are distinct pages. Kind 0, for a host of one shard: the positions in an unsettled
    page at which a substring on enough pages starts. Kind 1, for others: each substring with the number of its pages
    here, and (k1, k2, position) of where it starts in unsettled ones."""
    words = [r.stream.split(" ") for r in rows]
    names: dict[str, int] = {}
    tokens = np.array([names.setdefault(w, len(names)) for ws in words for w in ws])
    sizes = np.array([len(w) for w in words])
    page = np.repeat(np.arange(len(rows)), sizes)
    starts = np.cumsum(sizes) - sizes
    order, block = suffix_blocks(tokens, page)
    on = np.unique(block * len(rows) + page[order]) // len(rows)  # a block for each of its pages
    pages_of = np.bincount(on, minlength=int(block[-1]) + 1)
    open_page = np.array([r.kept is not None for r in rows])
    out = []
    if rows[0].shards == 1:
        at = np.sort(order[pages_of[block] >= rows[0].need])
        at = at[open_page[page[at]]]
        for p in np.unique(page[at]):
            pos = at[page[at] == p] - starts[p]
            out.append((0, host, 0, 0, rows[p].need, 0, rows[p].k1, rows[p].k2, pos.astype(np.int64).tobytes()))
    else:
        flat = [w for ws in words for w in ws]
        keys = np.array([(r.k1, r.k2) for r in rows], np.int64)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for b, (f, end) in enumerate(zip(first.tolist(), first[1:].tolist())):
            i = int(order[f])
            if i + RUN > len(flat) or page[i + RUN - 1] != page[i]:
                continue
            window = "\n".join(flat[i : i + RUN]).encode("utf-8", "surrogatepass")
            hashed = [xxhash.xxh64_intdigest(window, seed) - (1 << 63) for seed in (1, 2)]
            at = order[f:end][open_page[page[order[f:end]]]]
            where = np.column_stack((keys[page[at]], at - starts[page[at]])).astype(np.int64).tobytes()
            out.append((1, host, *hashed, rows[0].need, int(pages_of[b]), None, None, where))
    found = pd.DataFrame(out, columns=["kind", "host", "w1", "w2", "need", "n", "k1", "k2", "at"])
    return found.astype({"k1": "Int64", "k2": "Int64"})


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shards of rows sorted by host and shard."""
    key, rows = None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if (r.host, r.shard) != key:
                if rows:
                    yield _covered_in(key[0], rows)
                key, rows = (r.host, r.shard), []
            rows.append(r)
    if rows:
        yield _covered_in(key[0], rows)


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """k1, k2, at: the places of substrings by page."""
    for batch in batches:
        rows = []
        for at in batch["at"]:
            where = np.frombuffer(at, np.int64).reshape(-1, 3)
            rows += [(k1, k2, np.int64(pos).tobytes()) for k1, k2, pos in where.tolist()]
        yield pd.DataFrame(rows, columns=["k1", "k2", "at"])


def covered(streams: DataFrame) -> DataFrame:
    """k1, k2, gone: where in unsettled pages substrings start that are on enough pages of their host."""
    return covered_on(streams, None)


def covered_on(streams: DataFrame, least: DataFrame | None) -> DataFrame:
    """As `covered`; how many pages are enough is the square root of the host's, or what ``least`` (host, need) says.

    ``streams``: host, k1, k2, n, stream, kept of distinct pages. Hosts are counted after partial counts and dealt in
    shards of SHARD_TOKENS tokens, so a host with a third of all pages is many tasks; of a substring each shard sends
    one row.
    """
    parts = shuffle_parts(streams.sparkSession)
    size = streams.groupBy("host").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("pages"))
    shards = F.ceil(F.col("size") / SHARD_TOKENS).alias("shards")
    if least is None:
        need = F.greatest(F.ceil(F.sqrt("pages")), F.lit(MIN_PAGES)).alias("need")
        large = size.where((F.col("size") > SHARD_TOKENS) | (F.col("pages") > MIN_PAGES**2))
        large = large.select(F.col("host").alias("l_host"), shards, need)
    else:
        large = size.join(least, "host").select(F.col("host").alias("l_host"), shards, "need")
    dealt = streams.join(large, F.col("host") == F.col("l_host"), "left").drop("l_host").fillna(1, ["shards"])
    dealt = dealt.fillna(MIN_PAGES, ["need"]).withColumn("shard", F.pmod("k1", "shards").cast("int"))
    dealt = dealt.repartition(parts, "host", "shard").sortWithinPartitions("host", "shard")
    schema = "kind int, host string, w1 long, w2 long, need long, n long, k1 long, k2 long, at binary"
    found = stage(dealt.mapInPandas(released(_arrays), schema), "suffixes")
    key = ["host", "w1", "w2"]
    frequent = found.where("kind = 1").groupBy(*key).agg(F.sum("n").alias("pages"), F.max("need").alias("least"))
    frequent = frequent.where("pages >= least").select(*key)
    across = found.where("kind = 1 AND length(at) > 0").join(frequent, key).select("at")
    across = across.mapInPandas(_places, "k1 long, k2 long, at binary")
    every = found.where("kind = 0").select("k1", "k2", "at").union(across)
    return every.groupBy("k1", "k2").agg(F.collect_list("at").alias("gone"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of an unsettled page that may be kept and are not covered from end to end."""
    for batch in batches:
        texts = []
        for stream, kept, gone in zip(batch["stream"], batch["kept"], batch["gone"], strict=True):
            words = stream.split(" ")
            keep, starts = np.unpackbits(np.frombuffer(kept, np.uint8).reshape(2, -1), axis=1, count=len(words)).astype(bool)
            repeated = np.zeros(len(words), bool)
            for part in gone if gone is not None else ():
                at = np.frombuffer(part, np.int64)
                for k in range(RUN):
                    repeated[at + k] = True
            first = np.flatnonzero(starts)
            whole = np.logical_and.reduceat(repeated, first)
            keep &= ~np.repeat(whole, np.diff(np.append(first, len(words))))
            texts.append(" ".join([w for w, k in zip(words, keep, strict=True) if k]))
        yield pd.DataFrame({"o1": batch["k1"], "o2": batch["k2"], "kept_text": texts})


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams of the blocks whose head is frequent; a token of its own ends each, so that no substring spans two."""
    for batch in batches:
        rows = []
        for host, a1, a2, text, cuts, found in batch[["host", "a1", "a2", "text", "cuts", "found"]].itertuples(index=False):
            heads, stream, picked = set(found), [], []
            for i, block in enumerate(_cut(text, cuts)):
                if len(block) >= RUN and _head(block) in heads:
                    stream += [*block, f"\n{a1}.{a2}.{i}"]
                    picked.append(i)
            rows.append((host, a1, a2, len(stream), " ".join(stream), b"", text, cuts, np.array(picked, np.int32).tobytes()))
        yield pd.DataFrame(rows, columns=["host", "k1", "k2", "n", "stream", "kept", "text", "cuts", "picked"])


def _without_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Articles without their covered blocks, where these are no more than half of the tokens."""
    for batch in batches:
        rows = []
        for a1, a2, n, text, cuts, picked, gone in batch.itertuples(index=False):
            repeated = np.zeros(n, bool)
            for part in gone:
                for k in range(RUN):
                    repeated[np.frombuffer(part, np.int64) + k] = True
            blocks_, at, drop = _cut(text, cuts), 0, set()
            for i in np.frombuffer(picked, np.int32).tolist():
                if repeated[at : at + len(blocks_[i])].all():
                    drop.add(i)
                at += len(blocks_[i]) + 1
            if drop and 2 * sum(len(blocks_[i]) for i in drop) <= sum(map(len, blocks_)):
                rows.append((a1, a2, " ".join(" ".join(b) for i, b in enumerate(blocks_) if i not in drop)))
        yield pd.DataFrame(rows, columns=["o1", "o2", "own_text"])


def without_lines(read: DataFrame) -> DataFrame:
    """o1, o2, own_text: the marked articles that hold lines of their host, without them.

    Copies of an article on its host are one article. Heads of blocks are counted after partial counts; texts move only
    for articles with a frequent head.
    """
    articles = read.where("a1 IS NOT NULL")
    heads = stage(articles.select("host", "a1", "a2", "heads").dropDuplicates(["a1", "a2"]), "heads")
    half = F.ceil(F.count(F.lit(1)) / 2)
    least = heads.groupBy("host").agg(F.greatest(half, F.lit(MIN_ARTICLES)).alias("need"))
    each = heads.select("host", "a1", "a2", F.explode("heads").alias("head"))
    often = each.groupBy("host", "head").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= MIN_ARTICLES)
    often = often.join(least, "host").where(F.col("on") >= F.col("need")).select("host", "head")
    found = each.join(often, ["host", "head"]).groupBy("a1", "a2").agg(F.collect_set("head").alias("found"))
    own = articles.select("host", "a1", "a2", "text", "cuts").join(stage(found, "found"), ["a1", "a2"])
    schema = "host string, k1 long, k2 long, n long, stream string, kept binary, text string, cuts binary, picked binary"
    lines = stage(own.dropDuplicates(["a1", "a2"]).mapInPandas(_lines, schema), "lines")
    gone = covered_on(lines.select("host", "k1", "k2", "n", "stream", "kept"), least)
    cut = lines.join(gone, ["k1", "k2"]).select("k1", "k2", "n", "text", "cuts", "picked", "gone")
    return stage(cut.mapInPandas(_without_lines, "o1 long, o2 long, own_text string"), "own")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty pages have empty text, as have pages of boilerplate alone. Copies of a page on its host are one
    page and get the same text. A null url is a host of its own name, the empty one. Unclosed elements end where
    their parent does, a cut-off tag at the end of the page. Very long pages are read whole, in one row; their streams
    may exceed SHARD_TOKENS alone. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    read = stage(_read(pages), "pages")
    own = read.where("n > 0").select("host", "k1", "k2", "n", "stream", "kept")
    streams = stage(own.dropDuplicates(["k1", "k2"]), "streams")
    gone = covered(streams)
    unsettled = streams.where("kept IS NOT NULL").alias("s").join(
        gone.alias("g"), (F.col("s.k1") == F.col("g.k1")) & (F.col("s.k2") == F.col("g.k2")), "left"
    )
    unsettled = unsettled.select("s.k1", "s.k2", "s.stream", "s.kept", "g.gone")
    unsettled = unsettled.mapInPandas(_kept, "o1 long, o2 long, kept_text string")
    rest = read.where("text IS NULL").select("page_id", "url", "k1", "k2")
    rest = rest.join(unsettled, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left")
    rest = rest.select("page_id", "url", F.coalesce("kept_text", F.lit("")).alias("text"))
    settled = read.where("text IS NOT NULL").select("page_id", "url", "text", "a1", "a2")
    settled = settled.join(without_lines(read), (F.col("a1") == F.col("o1")) & (F.col("a2") == F.col("o2")), "left")
    every = settled.select("page_id", "url", F.coalesce("own_text", "text").alias("text")).union(rest)
    return every.withColumn("n_chars", F.length("text").cast("long"))


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return main_text(table(spark, sf_dir, "pages"))
