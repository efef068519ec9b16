"""The training-data operators against brute force, SQL, round trips and held-out labels, on small tables."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpuskit.llm import (
    bpe, components, edit_embedding, html_text, mixing, mtree, quality, queries, sharding, simhash, suffix_dedup, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
EXTRA = ("id", "tag", "size", "label", "held_out", "own", "fp", "kept", "pid", "target", "taken", "copies", "r_id")


def plain(t):
    return t or ""


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, nulls, ties and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgéö") for _ in range(rng.randint(1, 8)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(25)]
    out = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = word()
        out.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]), 1))
    line = "a passage that many documents share, long enough that windows of one hundred bytes repeat in all of them, "
    out += [(200 + i, word() + " " + line * 2 + word(), "en", "a", 2) for i in range(30)]
    out += [(300, "x" * 1500, "en", "b", 1500), (301, None, None, None, None), (302, "", "en", "", 0), (303, " \t\n", "en", "b", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({name: F.lit("extra") for name in EXTRA}).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """No id, equal ids, repeated rows."""
    text = "the same words again and again in this row " * 5
    return spark.createDataFrame(
        [(None, text), (None, text), (None, None), (7, "one"), (7, "one"), (7, "two"), (8, text)], "doc_id long, text string"
    ).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    found = [(r[0], int("passage" in plain(r[1])), int("passage" not in plain(r[1]))) for r in rows if r[0] < 300]
    return spark.createDataFrame([*found, (None, 1, 1), (5, 9, 9)], "doc_id long, toxic int, quality int")


def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    result = duck(sf_dir).execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, result.fetchall()))


def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


# ---- 1 sharding


def check_shards(got, n, shards=8):
    assert len(got) == n
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards and r.grown_shard is None and r.law == "bytes" for r in got)


def test_shards(docs, rows, odd, none):
    got = sharding.shard_by_bytes(docs).collect()
    check_shards(got, len(rows))
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        data = plain(text).encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    check_shards(sharding.shard_by_bytes(odd).collect(), 7)
    assert not sharding.shard_by_bytes(none).collect()


def test_shards_of_one_hot_text(spark):
    hot = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    rest = spark.range(60_000, 90_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sharding.shard_by_bytes(hot.union(rest)).toPandas()
    bytes_of = got.groupby("shard")["size"].sum()
    assert bytes_of.max() / bytes_of.min() < 1.01
    assert (got.groupby("shard")["slot"].nunique() == got.groupby("shard")["slot"].max() + 1).all()


def test_rows_without_id_and_text_are_cut(spark, monkeypatch):
    """60,000 rows that nothing tells apart: equal shards, and no cell that collects or numbers them all."""
    looked, cells = [], []
    between, place = sharding._between, sharding.place_splitters
    monkeypatch.setattr(sharding, "_between", lambda *a: (looked.append(between(*a).count()), between(*a))[1])
    monkeypatch.setattr(sharding, "place_splitters", lambda *a: (cells.append(place(*a)), cells[-1])[1])
    df = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    long = spark.createDataFrame([(1, "x" * 5_000_000)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("last")).collect()
    assert len(got) == 8 and all(abs(r.b - 7500) <= 10 and r.last == r.b - 1 for r in got)
    assert max(looked, default=0) <= sharding.LOOK and max(n for _, n in cells[0][1]) <= 20_000
    assert sharding.shard_by_bytes(df.union(long)).agg(F.sum("size")).first()[0] == 60_000 + 5_000_001


# ---- 2 HTML


def page(i, body):
    return i, f"http://Host.example:80/{i}", body


@pytest.mark.parametrize("tokens", [50_000, 60])
def test_lines_of_a_host_inside_of_marked_articles(spark, monkeypatch, tokens):
    """A line on half of the host's articles goes; a rarer one, near copies of one article, and a line that goes on stay."""
    monkeypatch.setattr(html_text, "SHARD_TOKENS", tokens)
    line = "Subscribe to our newsletter for the best stories of the week"
    rare = "The minister said on Monday that the new bridge is late"
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(12)]
    pages = {i: ([own[i]] + [line] * (i < 7) + [rare] * (i > 8) + [line + f" or {i}"] * (i == 8), "http://a/") for i in range(12)}
    body = ["An article that many pages of its host hold in nearly the same words", "It has a second paragraph which is never changed at all"]
    pages |= {20 + i: ([*body, f"Copy {i}"], "http://b/") for i in range(9)}
    rows = [(i, url, "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in bs) + "</article>") for i, (bs, url) in pages.items()]
    rows += [(100 + k, "http://c/", f"<article><p>{own[0]}</p><p>{line}</p></article>") for k in range(9)]  # copies: one article
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    want = {i: " ".join(b for b in bs if b != line) for i, (bs, _) in pages.items()}
    assert got == want | {100 + k: f"{own[0]} {line}" for k in range(9)}


def test_main_text(spark):
    shell = "<html><head><title>t</title><style>p{}</style></head><body><nav>Home Shop</nav>%s<footer>by us</footer>"
    cases = {
        1: (shell % "<article><h1>A &amp; b</h1><p>x <b>y</b>z<br>w&nbsp;v<p>q</article>", "A & b x yz w v q"),
        2: (shell % "<main><div class='cookie-notice'>no</div><p>yes</p><form>f</form></main>", "yes"),
        3: (shell % "<article>one<aside>side</aside> two<!-- c --><script>var a='</p>'</script></article>"
            "<div id=comments><article>said</article></div>", "one two"),
        4: (None, ""), 5: ("", ""), 6: ("plain &lt;text&gt; a<b", "plain <text> a"), 7: (shell % "<div hidden>h</div>", ""),
        8: ("<article>cut <p cla", "cut"),
        10: ("<div class='has-sidebar'><article>in<section class='reader-comments'>c</section></article></div>", "in"),
    }
    df = spark.createDataFrame([page(i, c[0]) for i, c in cases.items()] + [(9, None, None), (None, "x", "<p>k")],
                               "page_id long, url string, html string").withColumn("text", F.lit("extra"))
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    for i, (_, want) in cases.items():
        assert (got[i].text, got[i].n_chars) == (want, len(want)), i
    assert got[9].text == "" and got[None].text == "k"
    assert not html_text.main_text(df.limit(0)).collect()


def test_repeated_runs_of_a_host(spark, monkeypatch):
    menu, foot = "Home About Contact Login Search Help", "Copyright by us in the year of all years"
    body = "<body><div>%s</div><p>own words %d of page %d are kept</p><div>%s</div>"
    pages = [page(i, body % (menu, i, i, foot)) for i in range(20)] + [(99, "http://other/1", body % (menu, 99, 99, foot))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (html_text.SHARD_TOKENS, 40):
        monkeypatch.setattr(html_text, "SHARD_TOKENS", size)
        got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
        assert all(got[i] == f"own words {i} of page {i} are kept" for i in range(20))
        assert got[99] == f"{menu} own words 99 of page 99 are kept {foot}"  # alone on its host


def test_shared_sentences_stay(spark, monkeypatch):
    """Sentences and phrases that a few pages share, with or without an end of their own, are these pages' text."""
    said = "The minister said on Monday that the new bridge will be opened in May."
    pages = [page(1, f"<p>{said}</p>"), page(2, f"<p>{said}</p><p>Nobody else spoke about it at all.</p>"),
             page(3, "<p>The minister said on Monday that the budget was not yet settled at all.</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (html_text.SHARD_TOKENS, 10):
        monkeypatch.setattr(html_text, "SHARD_TOKENS", size)
        got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
        assert got == {i: " ".join(re.sub(r"</?p>", " ", body).split()) for i, _, body in pages}


def brute_blocks(pages, need):
    """Blocks of pages without markup but paragraphs, without those covered by runs on `need` distinct pages."""
    on = {}
    streams = {i: [b.split() for b in blocks] for i, blocks in pages.items()}
    for content in {tuple(map(tuple, s)) for s in streams.values()}:
        flat = [w for b in content for w in b]
        for run in {tuple(flat[k : k + html_text.RUN]) for k in range(len(flat) - html_text.RUN + 1)}:
            on[run] = on.get(run, 0) + 1
    out = {}
    for i, blocks in streams.items():
        flat = [w for b in blocks for w in b]
        gone = {k + d for k in range(len(flat) - html_text.RUN + 1) for d in range(html_text.RUN)
                if on[tuple(flat[k : k + html_text.RUN])] >= need}
        at, keep = 0, []
        for b in blocks:
            if not set(range(at, at + len(b))) <= gone:
                keep.append(" ".join(b))
            at += len(b)
        out[i] = " ".join(keep)
    return out


@pytest.mark.parametrize("tokens", [50_000, 60])
def test_blocks_against_all_runs(spark, monkeypatch, tokens):
    monkeypatch.setattr(html_text, "SHARD_TOKENS", tokens)
    rng = np.random.default_rng(8)
    common = [" ".join(rng.choice(list("abcd"), rng.integers(1, 15))) for _ in range(12)]
    pages = {i: [common[rng.integers(12)] for _ in range(6)] + [" ".join(rng.choice(list("abcd"), 20))] for i in range(60)}
    pages |= {i + 60: pages[i] for i in range(10)}  # copies are one page
    df = spark.createDataFrame([page(i, "".join(f"<p>{b}</p>" for b in bs)) for i, bs in pages.items()],
                               "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == brute_blocks(pages, int(np.ceil(np.sqrt(len({tuple(b) for b in pages.values()})))))


def test_copies_of_a_page_are_dealt_once(spark, monkeypatch):
    seen = []
    keep = html_text.covered
    monkeypatch.setattr(html_text, "covered", lambda streams: (seen.append(streams.count()), keep(streams))[1])
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("<p>same old words</p>").alias("html"))
    assert html_text.main_text(df).where("text = 'same old words'").count() == 3000 and seen == [1]


def test_suffix_blocks():
    rng = np.random.default_rng(1)
    tokens, page_of = rng.integers(0, 2, 400), np.repeat(np.arange(8), 50)
    order, block = html_text.suffix_blocks(tokens, page_of)
    got = {}
    for position, b in zip(order.tolist(), block.tolist()):
        got.setdefault(b, set()).add(position)
    want = {}
    for i in range(400):
        inside = i + html_text.RUN <= 400 and page_of[i + html_text.RUN - 1] == page_of[i]
        want.setdefault(tuple(tokens[i : i + html_text.RUN]) if inside else i, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pages_against_the_markup(spark, sf_dir):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op2_main_text"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        inner = re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", inner))
        assert r.text == " ".join(html.unescape(inner).split())


# ---- 3 toxicity


def brute_segments(values):
    """Maximal scoring segments by their definition: by best score first, then in the remaining parts."""
    def solve(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += values[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                    best = (i, j, total)
        return [] if best is None else solve(a, best[0]) + [best] + solve(best[1] + 1, b)
    return solve(0, len(values))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-0.5, -0.5, -0.5, rng.random() * 3]) for _ in range(rng.randint(1, 18))]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(values) if v > 0])
        want = brute_segments(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity(docs, rows, labels, odd, none):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id < 300:
            assert r.predicted == int(200 <= r.doc_id), r
    assert len(toxicity.score_toxicity(odd, labels).collect()) == 7
    assert not toxicity.score_toxicity(none, labels).collect()
    empty = labels.limit(0)
    assert len({r.score for r in toxicity.score_toxicity(docs, empty).collect()}) == 1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not 200 <= r[0] < 300}


# ---- 4 top k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(300)]
    vectors += [(300 + i, [0.5, 0.5, -0.25, 1.0, 0.0, 0.0]) for i in range(90)]  # ties
    bad = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf"), 1.0]), (1004, []), (None, [1.0])]
    df = spark.createDataFrame([*vectors, *bad, vectors[0]], "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for i in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[i] @ x), j) for j, x in whole.items() if j != i)[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, mtree.top_k(df.repartition(4)).collect())) == sorted(want)
    assert not mtree.top_k(df.limit(0)).collect()
    assert [tuple(r) for r in mtree.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0, 9.0])], "vec_id long, embedding array<float>")).collect()] == [(0, 1, 1, 64 * 128)]


def test_small_pages_and_many_roots(spark, monkeypatch):
    monkeypatch.setattr(mtree, "NODE", 20)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "PAGES_AT_ONCE", 2)
    monkeypatch.setattr(mtree, "MAX_SAMPLE", 40)
    test_top_k(spark)


# ---- 5 repeated strings


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data, gone = plain(text).encode(), set()
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(data[k : k + 100])
        spans = sum(k - 1 not in gone for k in gone)
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        out[i] = (len(data), len(gone), spans, kept)
    return out


@pytest.mark.parametrize("hot", [2_000, 10])
def test_repeated_strings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats([r[:2] for r in rows])


def test_repeats_in_pieces(docs, rows, monkeypatch):
    want = brute_repeats([r[:2] for r in rows])
    for name, value in (("PIECE", 128), ("SLAB", 3_000), ("BLOCK", 1_000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    c = suffix_dedup._contexts_of([plain(r[1]).encode() for r in rows])
    assert c["n"].sum() == sum(max(v[0] - 99, 0) for v in want.values())  # every window is in one context


def test_hot_windows_are_reduced_before_they_are_sent():
    text = "".join(random.Random(8).choices("abcdefgh ", k=160))
    blob = suffix_dedup._pack([np.array([k], np.int64) for k in (0, 61, 0)])
    batch = suffix_dedup.pd.DataFrame(
        [(i, 7, text, [], [blob]) for i in (3, 1, 2, 1)], columns=["id", "tag", "text", "near", "hot"]
    )
    out = list(suffix_dedup._cut(4)(iter([batch])))
    sent = [b for f in out for k, b in zip(f["kind"], f["data"]) if k == 9]
    rows = [suffix_dedup._unpack(b, [np.uint64] + [np.int64] * 5)[0] for b in sent]
    assert {i for r in rows for i in r[1].tolist()} == {1}
    assert sorted(at for r in rows for at in r[3].tolist()) == list(range(61))
    gone = sorted((i, *suffix_dedup._unpack(b, [np.int64] * 2)[0]) for f in out for k, i, b in zip(f["kind"], f["id"], f["data"]) if k == 0)
    assert [(i, at.tolist(), n.tolist()) for i, at, n in gone] == [(2, [0], [61]), (3, [0], [61])]


def test_odd_rows_of_repeats(odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    text = "the same words again and again in this row " * 5
    first = brute_repeats([(0, text)])[0]
    assert len(got) == 7
    assert all((r.n_removed, r.n_spans) == first[1:3] for r in got if r.id == suffix_dedup.NO_ID and r.n_bytes)
    assert [r.n_removed for r in got if r.id == 8] == [len(text)]
    assert not suffix_dedup.remove_repeats(none).collect()
    assert suffix_dedup.without_repeats(odd).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_merged_transforms():
    rng = np.random.default_rng(2)
    common = rng.integers(97, 99, 300)
    parts = [np.append(np.concatenate([rng.integers(97, 99, 20), common[a : a + 150]]), 255) for a in (0, 3, 50, 90, 150)]
    text = np.concatenate(parts).astype(np.uint8)
    block = suffix_dedup.merge_transforms(text, np.array([len(p) for p in parts]))
    groups = {}
    for i in range(len(text) - 99):
        if 255 not in text[i : i + 100]:
            groups.setdefault(text[i : i + 100].tobytes(), set()).add(int(block[i]))
    assert all(len(b) == 1 for b in groups.values()) and len(set.union(*groups.values())) == len(groups)


# ---- 6 edit embedding


def test_fingerprints(docs, rows, odd, none):
    got = {r.id: r for r in edit_embedding.fingerprint_documents(docs).collect()}
    ordered = sorted((r[0], plain(r[1])) for r in rows)
    for (i, text), (j, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        assert got[i].edited_text == text[: len(text) - half] + following[:half] and got[i].n_chars == len(text)
        a, b = (np.frombuffer(bytes.fromhex(got[k].fingerprint), np.uint8)[None] for k in (i, j))
        assert got[i].near_next == edit_embedding.likeness(a, b)[0]
    prints = {}
    for i, text in ordered:
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert len(edit_embedding.fingerprint_documents(odd).collect()) == 7
    assert not edit_embedding.fingerprint_documents(none).collect()


def test_walk_against_steps():
    for text in ("hello, wörld", "a", "ab" * 400):
        codes = edit_embedding._codes(text)
        at, want = 0, []
        for step in range(2 * len(codes)):
            if at == len(codes):
                break
            want.append(codes[at])
            at += int(edit_embedding.DRAWS[step % edit_embedding.PERIOD]) >> (int(codes[at]) & 31) & 1
        assert edit_embedding.walk([codes, edit_embedding._codes("other")])[0][: len(want)].tolist() == want


@pytest.mark.parametrize("room", [3.0, 1.5])
def test_walk_reaches_the_end(monkeypatch, room):
    if room < 3:
        monkeypatch.setattr(edit_embedding, "_room", lambda n: (room * n).astype(int))
    rng = random.Random(9)
    codes = [edit_embedding._codes("".join(rng.choices("abcdefghijklmnop ", k=rng.choice([0, 1, 10, 50, 700])))) for _ in range(200)]
    for text, given in zip(codes, edit_embedding.walk(codes), strict=True):
        at, want = 0, []
        while at < len(text):
            want.append(text[at])
            at += int(edit_embedding.DRAWS[len(want) - 1 & edit_embedding.PERIOD - 1]) >> (int(text[at]) & 31) & 1
        assert given.tolist() == want


def test_edits_keep_fingerprints_near(spark):
    rng = random.Random(6)
    text = [rng.choice("abcdefghijklmnop ") for _ in range(2000)]
    changed = text.copy()
    for _ in range(6):
        changed[rng.randrange(2000)] = "z"
    changed.insert(1200, "y")
    other = [rng.choice("abcdefghijklmnop ") for _ in range(2000)]
    prints = edit_embedding.fingerprints(["".join(t) for t in (text, changed, other)])
    assert edit_embedding.likeness(prints[:1], prints[1:2])[0] > 0.8 > 0.3 > edit_embedding.likeness(prints[:1], prints[2:])[0]
    df = spark.createDataFrame([(p.tobytes().hex(),) for p in prints] * 2, "fingerprint string")
    links = edit_embedding.near_fingerprints(df).collect()
    assert {frozenset(r) for r in links} == {frozenset(p.tobytes().hex() for p in prints[:2])}


# ---- 7 BPE


def test_bpe_like_the_library(docs, rows, odd, none, monkeypatch):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = "\x1c\x1d a　b  c\n\n  d \x85\xa0 e's <|endoftext|> 中文字 ١٢٣ \U0001F600 x́ it'll \t" + "é" * 300 + "ab" * 200
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(900, hard)], "doc_id long, text string"))
    texts = {**{r[0]: plain(r[1]) for r in rows}, 900: hard}
    for r in bpe.encode_documents(more, str(path), public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    for r in bpe.encoded_digests(docs).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), joined, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert len(bpe.encoded_digests(odd).collect()) == 7 and not bpe.encoded_digests(none).collect()
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinäß") for _ in range(n)) for n in (1, 2, 31, 32, 33, 64, 100, 200, 255, 256, 257)]
    words += ["ab" * 128, "\u00e9" * 128, "x" * 256, " " + "the" * 85]
    spark = docs.sparkSession
    mixed = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    for r in bpe.encode_documents(mixed, str(path), public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(words[r.doc_id])
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    for r in bpe.encode_documents(more.coalesce(1), str(path), public_tokenizers.PATTERN).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
    for word in ("a" * 700, "abcabc" * 90, "".join(rng.choice("etaoin") for _ in range(900))):
        assert bpe.merge_long(word.encode(), ranks) == library.encode_ordinary(word)


# ---- 8 mixing


def brute_quotas(weights, seats):
    out = [0] * len(weights)
    for _ in range(seats if sum(weights) else 0):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_apportionment(spark):
    rng = random.Random(8)
    cases = [([rng.choice([0.0, rng.random() * 10**rng.randint(0, 4)]) for _ in range(rng.randint(1, 9))], rng.randint(0, 60)) for _ in range(60)]
    flat = [(g, i, w, seats) for g, (weights, seats) in enumerate(cases) for i, w in enumerate(weights)]
    df = spark.createDataFrame(flat, "g int, i int, w double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "i", "w", "seats").collect()}
    for g, (weights, seats) in enumerate(cases):
        assert [got[g, i] for i in range(len(weights))] == brute_quotas(weights, seats), (weights, seats)


def test_mix(docs, rows, odd, none):
    got = mixing.mix_sources(docs).collect()
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", plain(r[1]))) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for source, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 32
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert len(mixing.mix_sources(odd).collect()) == 7 and not mixing.mix_sources(none).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(sizes[r.doc_id] for r in mixed.collect())
    assert abs(words / sum(sizes.values()) - 1) < 0.2


def test_mix_of_many_shards_is_the_same_as_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), shard_rows=20)
    result = duck(sf_dir).execute(mixing.OP8_SQL.replace("2000.0", "20.0"))
    columns = [d[0] for d in result.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(result.fetchall())


def test_mix_stays_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 9 SimHash


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), plain(text)))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(prints):
    left, out = sorted(prints), {}
    while left:
        root, frontier = left[0], [left.pop(0)]
        while frontier:
            at = frontier.pop()
            out[at] = root
            near = [j for j in left if (prints[j] ^ prints[at]).bit_count() <= 3]
            left = [j for j in left if j not in near]
            frontier += near
    return out


def test_simhash(docs, rows, odd, none):
    prints = {r[0]: brute_simhash(r[1]) for r in rows}
    roots = brute_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == roots
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()} == {(None, 8), (None, None), (7, 7), (8, 8)}
    assert sorted(str((r.doc_id, r.text is None)) for r in simhash.keep_one(odd).collect()) == ["(7, False)", "(7, False)", "(8, False)", "(None, True)"]
    assert not simhash.near_duplicates(none).collect() and not simhash.keep_one(none).collect()


@pytest.mark.parametrize("long_list", [20_000, 3])
def test_links_connect_all_near_prints(spark, long_list):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            prints.add(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    named = dict(enumerate(sorted(prints)))
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in named.values()]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), long_list)
    pairs = {(r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect()}
    assert all((u ^ v).bit_count() <= 3 for u, v in pairs)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    groups = {}
    for i, root in brute_components(named).items():
        groups.setdefault(root, set()).add(named[i])
    got = {}
    for p in prints:
        s = int(np.uint64(p).astype(np.int64))
        got.setdefault(roots.get(s, s), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


# ---- 10 quality


def test_quality(docs, rows, labels, odd, none):
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id < 200) for r in held) >= 0.9 * len(held)
    assert len(quality.score_quality(odd, labels).collect()) == 7
    assert not quality.score_quality(none, labels).collect()
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def whole_co_training(known, y, pool):
    """The two views' models by definition, all rows in memory."""
    x, labels, free = [v.copy() for v in known], [y.copy(), y.copy()], np.arange(len(pool[0]))
    models = [quality.fit(v, y) for v in x]
    for _ in range(quality.ROUNDS):
        taken, most = np.zeros(len(free), bool), max(1, int(quality.SHARE * len(free)))
        for teacher, pupil in ((0, 1), (1, 0)):
            logit = models[teacher].logit(pool[teacher][free])
            level = np.floor(np.abs(logit) * quality.LEVELS)
            named = (1 / (1 + np.exp(-np.abs(logit))) >= quality.SURE) & (level >= np.sort(level)[-most:][0])
            x[pupil] = np.concatenate([x[pupil], pool[pupil][free[named]]])
            labels[pupil] = np.concatenate([labels[pupil], (logit[named] > 0).astype(float)])
            taken |= named
        free = free[~taken]
        models = [quality.fit(*z) for z in zip(x, labels)]
    return models


def test_every_unlabelled_row_can_teach(spark):
    rng = np.random.default_rng(3)
    n, known = 20_000, 300
    good = rng.random(n) < 0.5
    words = np.array(["tree", "House", "and.", "42", "#!", "ox"])
    texts = [" ".join(rng.choice(words[:3] if g else words[2:], rng.integers(3, 9))) for g in good]
    data = [(i, t, "en", "a" if g else str(i % 5), len(t)) for i, (t, g) in enumerate(zip(texts, good.tolist()))]
    labels = [(i, int(rng.random() < 0.1) ^ int(good[i])) for i in range(n - known, n)]
    df, named = spark.createDataFrame(data, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: (r.content_score, r.metadata_score) for r in quality.score_quality(df, named).collect()}

    rows = quality.views(df, named).toPandas()
    x = [np.stack(rows[v].tolist()).astype(float) for v in ("content", "metadata")]
    use, pool = rows["label"].notna().to_numpy(), (rows["label"].isna() & ~rows["held_out"]).to_numpy()
    assert pool.sum() > 12_500
    models = whole_co_training([v[use] for v in x], rows.loc[use, "label"].to_numpy(float), [v[pool] for v in x])
    want = np.column_stack([1 / (1 + np.exp(-m.logit(v))) for m, v in zip(models, x)])
    assert np.abs(want - np.array([got[i] for i in rows["doc_id"]])).max() < 1e-3


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.QUERIES["op10_quality"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    got = queries.QUERIES["op3_toxicity"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted for r in got if r.toxic == 0) <= 1
    assert sum(r.predicted for r in got if r.toxic) >= 0.7 * sum(r.toxic for r in got)
