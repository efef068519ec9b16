"""Derived tables over the given ones, written once as SQL that Spark and DuckDB both run.

Every view reads whole tables. A rule such as ``id % 50 = 0`` assigns a value to a row, it never
leaves a row out. The few places where the dialects differ are named in DIALECTS.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The voices of the derived tables (key, provider, label, voice), in their order, and the default.
NARRATORS = (
    ("birch", "openai", "Birch", "birch-1"),
    ("cedar", "elevenlabs", "Cedar", "cedar-2"),
    ("maple", "openai", "Maple", "maple-1"),
    ("rowan", "elevenlabs", "Rowan", "rowan-1"),
    ("alder", "elevenlabs", "Alder", "alder-3"),
    ("hazel", "openai", "Hazel", "hazel-1"),
    ("willow", "elevenlabs", "Willow", "willow-2"),
)
DEFAULT_NARRATOR = "rowan"
_KEYS = ",".join(n[0] for n in NARRATORS)

DIALECTS = {
    "spark": {
        # map over the lines of a text, {x} the line and {i} its 0-based position
        "lines": "array_join(transform(split({text}, chr(10)), (x, i) -> {body}), chr(10))",
        "x": "x",
        "i": "i",
        "iso": "date_format({c}, 'yyyy-MM-dd HH:mm:ss,SSS')",
        "explode": (
            "SELECT doc_id, pos AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, chr(10))) t"
            " AS pos, line"
        ),
        "each": "explode(array(",
        "end": "))",
    },
    "duckdb": {
        "lines": "array_to_string(list_transform(string_split({text}, chr(10)), lambda x, j: {body}), chr(10))",
        "x": "x",
        "i": "(j - 1)",
        "iso": "strftime({c}, '%Y-%m-%d %H:%M:%S,%g')",
        "explode": (
            "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line"
            " FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
        ),
        "each": "unnest([",
        "end": "])",
    },
}

_ROMANS = "I,II,III,IV,V,VI,VII,VIII,IX,X,XI,XII,XIII,XIV,XV,XVI,XVII,XVIII,XIX,XX,XXI,XXII,XXIII,XXIV,XXV,XXVI"

# Heading before every fourth line of a document; some numbers jump, some headings echo.
_HEAD_NO = "(CAST(({i} - {i} % 4) / 4 AS INT) % 26 + 1)"
_HEADING = (
    "CASE doc_id % 4 WHEN 0 THEN 'CHAPTER' WHEN 1 THEN 'Book' WHEN 2 THEN 'Part' ELSE 'FEDERALIST' || chr(10) || 'No.' END"
    " || ' ' ||"
    " CASE WHEN doc_id % 4 = 3 OR {i} % 3 = 0 THEN CAST({no} + CASE WHEN {no} % 4 = 2 THEN 40 ELSE 0 END AS STRING)"
    f" ELSE split_part('{_ROMANS}', ',', {{no}}) END || '. Of ' || lang || ' things'"
)
_NOISE = (
    "CASE (doc_id + {i}) % 8 WHEN 0 THEN ' [12, 15]' WHEN 1 THEN ' https://example.org/p?q=' || lang"
    " WHEN 2 THEN ' e.g. this' WHEN 3 THEN ' doi:10.1000/182 et al.' WHEN 4 THEN ' cf. Fig. 3 vs. i.e.'"
    " WHEN 5 THEN ' [7–9]' WHEN 6 THEN '  10.5555/abc' ELSE '' END"
)
_BOOK_LINE = (
    "CASE WHEN {i} % 4 = 0 OR ({i} % 4 = 2 AND doc_id % 5 = 1) THEN {heading} || chr(10) ELSE '' END || {x} || {noise}"
)

VIEWS: dict[str, str] = {
    "users": """
        SELECT c_custkey AS id, 'g' || CAST(c_custkey AS STRING) AS google_id,
               lower(c_name) || '@Example.org' AS email, c_name AS display_name,
               CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role,
               c_custkey % 3 = 0 AS ab_test_access
        FROM customer""",
    "books": """
        SELECT o_orderkey AS id, 'Book ' || CAST(o_orderkey AS STRING) AS title, c_name AS author,
               'book' || CAST(o_orderkey AS STRING) || '.pdf' AS filename,
               CASE WHEN o_orderkey % 5 = 0 THEN 'storage/pdfs/book' ELSE 'pdfs/' || CAST(o_orderkey AS STRING) || '/book' END
                 || CAST(o_orderkey AS STRING) || '.pdf' AS pdf_path,
               CASE WHEN o_orderkey % 97 = 0 THEN 'legacy' WHEN o_orderkey % 50 = 0 THEN 'error'
                    WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'review'
                    ELSE 'synthesizing' END AS status,
               o_orderkey % 7 = 0 AS hidden,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS INT) END AS page_count,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE c_mktsegment END AS genre,
               CAST(year(o_orderdate) AS INT) AS year, CAST(NULL AS STRING) AS notes,
               CASE WHEN o_orderkey % 9 = 7 THEN NULL WHEN o_orderkey % 9 = 8 THEN 'gone'
                    ELSE split_part('{keys}', ',', CAST(o_orderkey % 9 AS INT) + 1) END AS tts_narrator,
               CASE o_orderkey % 4 WHEN 0 THEN 'Read slowly' WHEN 1 THEN '' ELSE NULL END AS tts_instructions,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS uploaded_by,
               o_orderdate AS created_at
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""".replace("{keys}", _KEYS),
    "segments": """
        SELECT book_id * 1000 + seg_order AS id, book_id, seg_order,
               repeat('Prose of line ' || CAST(seg_order AS STRING) || '. ', CAST(quantity AS INT)) AS text,
               CASE WHEN seg_order % 3 = 0 THEN 'Chapter ' || CAST(seg_order AS STRING) ELSE NULL END AS chapter_title,
               CASE WHEN status <> 'ready' THEN NULL
                    WHEN book_id % 4 = 0 THEN 'storage/audio/' || CAST(book_id AS STRING) || '/'
                      || lpad(CAST(seg_order AS STRING), 4, '0') || '.mp3'
                    ELSE 'audio/' || CAST(book_id AS STRING) || '/' || lpad(CAST(seg_order AS STRING), 4, '0') || '.mp3'
               END AS audio_path,
               status, quantity AS duration
        FROM (SELECT l_orderkey AS book_id, l_linenumber - 1 AS seg_order, sum(l_quantity) AS quantity,
                     CASE WHEN l_orderkey % 3 = 0 OR min(l_returnflag) = 'A' THEN 'ready'
                          WHEN max(l_returnflag) = 'R' THEN 'error'
                          WHEN l_linenumber % 2 = 0 THEN 'processing' ELSE 'pending' END AS status
              FROM lineitem GROUP BY l_orderkey, l_linenumber) lines""",
    # one row per line item, so that an (order, line number) occurs more than once
    "segment_log": """
        SELECT l_orderkey AS book_id, l_linenumber - 1 AS seg_order, l_partkey AS part FROM lineitem""",
    # each segment has takes of two different narrators
    "segment_audio": """
        SELECT id * 10 + k AS id, id AS segment_id, split_part('{keys}', ',', k + 1) AS narrator,
               CASE WHEN book_id % 2 = 0 OR (id + k) % 3 = 0 THEN 'ready' WHEN (id + k) % 3 = 1 THEN 'pending'
                    ELSE 'error' END AS status,
               CASE WHEN (id + k) % 11 = 0 THEN NULL WHEN (id + k) % 13 = 0 THEN ''
                    ELSE 'audio/' || CAST(book_id AS STRING) || '/' || split_part('{keys}', ',', k + 1) || '/'
                      || lpad(CAST(seg_order AS STRING), 4, '0') || '.mp3' END AS audio_path,
               duration
        FROM (SELECT *, {each}CAST(book_id % 7 AS INT), CAST((book_id + 1 + seg_order % 6) % 7 AS INT){end} AS k
              FROM segments) both_takes
        """.replace("{keys}", _KEYS),
    "narrators": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{k}', '{p}', '{la}', '{v}')" for i, (k, p, la, v) in enumerate(NARRATORS))
    + ") AS t(pos, key, provider, label, voice)",
    # a registry that grows with the data: one preset per supplier, some without a provider
    "presets": """
        SELECT CAST(s_suppkey AS INT) AS pos, 'voice_' || CAST(s_suppkey AS STRING) AS key,
               CASE s_suppkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'elevenlabs' ELSE NULL END AS provider,
               s_name AS label, 'v' || CAST(s_nationkey AS STRING) AS voice
        FROM supplier""",
    "pipeline_events": """
        SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id * 7 % 16000 END AS book_id,
               CASE WHEN event_type = 'view' THEN NULL ELSE 'app.tasks.' || event_type END AS task,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE repeat(props, CAST(1 + event_id % 600 AS INT)) END AS message,
               CASE WHEN event_id % 97 = 5 THEN repeat(props, 2000) WHEN event_id % 3 = 0 THEN NULL
                    WHEN event_id % 3 = 1 THEN '' ELSE 'trace ' || props END AS traceback,
               ts AS created_at
        FROM events""",
    "host_metrics": """
        SELECT 'h' || CAST(user_id % 5 AS STRING) AS host, ts AS seen_at, value % 100 AS mem_pct,
               (value * 3) % 100 AS swap_pct, value % 8 AS load1, CAST(1 + user_id % 4 AS INT) AS cpus
        FROM events""",
    "beats": "SELECT 'host-' || CAST(user_id % 40 AS STRING) AS host, ts AS seen_at FROM events",
    "ab_tests": """
        SELECT s_suppkey AS id, s_name AS title, 'Clip of ' || s_name AS description, s_suppkey % 4 <> 0 AS published,
               s_acctbal AS created_at
        FROM supplier""",
    "ab_options": """
        SELECT id * 2 AS id, id AS ab_test_id, 'A' AS key, 'First of ' || title AS label,
               CASE WHEN id % 6 = 0 THEN NULL ELSE 'ab_tests/' || CAST(id * 2 AS STRING) || '.mp3' END AS audio_key,
               0 AS opt_order
        FROM ab_tests
        UNION ALL
        SELECT id * 2 + 1, id, 'B', 'Second of ' || title, 'ab_tests/' || CAST(id * 2 + 1 AS STRING) || '.mp3', 1
        FROM ab_tests""",
    "ab_votes": """
        SELECT event_id AS id, event_id % 117 AS ab_test_id, user_id % 20 AS user_id,
               CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'no_diff' ELSE 'C' END
                 AS choice,
               ts AS created_at
        FROM events""",
    "progress": """
        SELECT event_id AS id, user_id, event_id * 7 % 16000 AS book_id,
               CASE WHEN event_id % 41 = 0 THEN 'broken' ELSE CAST(event_id % 9 AS STRING) END AS seg_idx,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS t,
               ts AS updated
        FROM events""",
    "saved_voices": """
        SELECT user_id, book_id, max(split_part('{keys}', ',', CAST(id % 7 AS INT) + 1)) AS narrator
        FROM progress GROUP BY user_id, book_id""".replace("{keys}", _KEYS),
    "inventory": """
        SELECT CASE WHEN id % 6 = 0 THEN 'lost/' ELSE '' END || pdf_path AS key FROM books
        UNION ALL
        SELECT key FROM (
          SELECT {each}audio_path, 'audio/' || book || '/' || split_part('{keys}', ',', k + 1) || '/' || file,
                 'audio/' || book || '/alder/' || file || '.bak', 'audio-archive/' || book || '/T0/' || file{end} AS key
          FROM (SELECT audio_path, CAST(book_id AS STRING) AS book, CAST(book_id % 7 AS INT) AS k,
                       lpad(CAST(seg_order AS STRING), 4, '0') || '.mp3' AS file FROM segments) named) files
        WHERE key IS NOT NULL""".replace("{keys}", _KEYS),
    "log_lines": """
        SELECT event_id AS id, ts AS seen_at, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'worker' END AS source,
               {iso_ts} || CASE event_type WHEN 'error' THEN ' ERROR' WHEN 'signup' THEN ' WARNING' ELSE ' INFO' END
                 || ' app.' || event_type || ': user ' || CAST(user_id AS STRING) || ' sent: ' || props AS line
        FROM events""",
    "queue_items": """
        SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'synth' WHEN 'view' THEN 'ingest'
                 WHEN 'purchase' THEN 'synth_el' WHEN 'signup' THEN 'celery' ELSE 'other' END AS queue
        FROM events""",
    "work_items": """
        SELECT event_id AS id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'celery@' END || 'worker-' || CAST(user_id % 12 AS STRING)
                 AS worker,
               CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'reserved' ELSE 'active' END AS state,
               CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'app.tasks.' || event_type END AS task,
               CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts END AS started
        FROM events""",
    "doc_lines": "{explode}",
    # Each document becomes one book: banners, contents, numbered headings, citations, references.
    "book_text": """
        SELECT doc_id, lang, CAST(1 + floor(length(text) / 2500) AS INT) AS page_count,
               'Produced by volunteers' || chr(10) || '*** START OF THIS PROJECT GUTENBERG EBOOK ' || lang || ' ***'
               || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Contents.' || chr(10) || 'Chapter I 7' || chr(10)
               || 'Chapter II 12' || chr(10) ELSE '' END || {body}
               || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || chr(10) || 'References' || chr(10) || '[1] Someone, 1999.' ELSE '' END
               || chr(10) || '*** END OF THE PROJECT GUTENBERG EBOOK ***' || chr(10) || 'License' AS text
        FROM documents""",
    # Twelve document lines a page, each whole in a block of its own, the fourth block of a page with a second line.
    # Beside them stand blocks that are no document lines: a heading over the first line (part 2), a running footer
    # (part 3) and, in a quarter of the documents, an image (part 4).
    "spans": """
        SELECT doc_id, CAST((line_no - line_no % 12) / 12 AS INT) AS page_no,
               CAST((line_no % 12) * 5 + CASE part WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 1 END AS INT) AS block_no,
               CASE WHEN part = 1 THEN 1 ELSE 0 END AS line_no, 0 AS span_no,
               CASE WHEN part = 4 THEN 1 ELSE 0 END AS block_type,
               CASE WHEN part = 1 THEN CASE WHEN line_no % 12 = 3 THEN 'phen end-' ELSE '' END
                    WHEN part = 2 THEN upper(substr(replace(line, 'ß', 'ss'), 1, 40))
                    WHEN part = 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'Page 90 of 239.' WHEN doc_id % 3 = 1 THEN '- xii -'
                         ELSE substr(line, 1, 30) END
                    WHEN part = 0 AND line_no % 12 = 3 THEN line || ' hy-' ELSE line END AS text,
               CASE WHEN part = 2 THEN 18.4e0 WHEN line_no % 5 = 4 THEN 8.0e0 WHEN line_no % 3 = 0 THEN 10.5e0
                    ELSE 11.2e0 END AS size,
               CASE WHEN part = 2 AND doc_id % 2 = 0 THEN 4e0 WHEN part = 3 THEN 770e0
                    ELSE 80e0 + (line_no % 12) * 50e0 + 4e0 * part END AS y0,
               CASE WHEN part = 2 AND doc_id % 2 = 0 THEN 16e0 WHEN part = 3 THEN 782e0
                    ELSE 92e0 + (line_no % 12) * 50e0 END AS y1,
               800e0 AS page_h
        FROM (SELECT doc_id, line_no, line, {each}0, 1, 2, 3, 4{end} AS part FROM doc_lines) parts
        WHERE part < 2 OR (part = 2 AND line_no % 12 = 0) OR (part = 3 AND line_no % 12 = 11)
           OR (part = 4 AND line_no % 12 = 9 AND doc_id % 4 = 2)""",
    "metadata_json": """
        SELECT event_id AS id,
               CASE event_id % 7
                 WHEN 0 THEN '{{"author": " Ann ", "genre": "", "year": 1999.7, "notes": "n"}}'
                 WHEN 1 THEN '{{"author": "  ", "genre": "Fiction", "year": "1999.5", "notes": null}}'
                 WHEN 2 THEN '{{"author": null, "year": " 1999 ", "notes": " two words "}}'
                 WHEN 3 THEN '{{"genre": "History", "year": null}}'
                 WHEN 4 THEN '{{"year": "abc", "author": "' || event_type || '"}}'
                 WHEN 5 THEN '{{"year": ' || CAST(1900 + user_id AS STRING) || ', "author": "' || event_type || '"}}'
                 ELSE '{{"year": "' || CAST(1900 + user_id AS STRING) || '", "genre": "' || event_type || '"}}' END AS raw
        FROM events""",
    # the presets a grid may name: one for every second part
    "grid_presets": """
        SELECT 'preset_' || CAST(p_partkey AS STRING) AS key, p_name AS label FROM part WHERE p_partkey % 2 = 1 OR p_partkey = 2""",
    "grid_requests": """
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'onyx, ash' WHEN 1 THEN 'marin,,cedar ' ELSE 'ballad' END AS voices,
               CASE c_custkey % 5 WHEN 0 THEN 'preset_1,preset_2' WHEN 1 THEN 'preset_3, nosuch'
                    ELSE 'preset_' || CAST(1 + c_custkey % 20 AS STRING) END AS presets,
               CAST(1 + c_custkey % 3 AS INT) AS takes,
               CASE WHEN c_custkey % 4 = 0 THEN 'gemini' WHEN c_custkey % 4 = 1 THEN 'elevenlabs' ELSE 'openai' END AS provider
        FROM customer""",
}


def _render(name: str, dialect: str) -> str:
    words = DIALECTS[dialect]
    sql = VIEWS[name]
    if name == "book_text":
        fill = {"i": words["i"], "x": words["x"]}
        no = _HEAD_NO.format(**fill)
        heading = _HEADING.format(no=no, **fill)
        body = _BOOK_LINE.format(heading=heading, noise=_NOISE.format(**fill), **fill)
        return sql.replace("{body}", words["lines"].format(text="text", body=body))
    if name == "log_lines":
        return sql.replace("{iso_ts}", words["iso"].format(c="ts"))
    if name == "doc_lines":
        return words["explode"]
    if name == "metadata_json":
        return sql.replace("{{", "{").replace("}}", "}")
    return sql.replace("{each}", words["each"]).replace("{end}", words["end"])


def with_clause(sql: str, dialect: str, extra: dict[str, str] | None = None) -> str:
    """The CTEs that ``sql`` needs, in order of dependence, as the text before the main SELECT."""
    known = {**{name: None for name in VIEWS}, **(extra or {})}
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in known:
            if name not in done and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                body = known[name] or _render(name, dialect)
                done[name] = ""  # no cycles here: keeps the order of first need
                visit(body)
                del done[name]
                done[name] = body

    visit(sql)
    if not done:
        return ""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in done.items()) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A derived view, or a given table, as a DataFrame.

    With ``partitions``, views over the documents deal them evenly over so many, since a text costs much per row.
    """
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    main = f"SELECT * FROM {name}"
    ctes = with_clause(main, "spark")
    bases = [b for b in BASE if re.search(rf"\b(?:FROM|JOIN)\s+{b}\b", ctes)]
    hint = f"/*+ REPARTITION({partitions}) */" if partitions else ""
    heads = [f"{b} AS (SELECT {hint if b == 'documents' else ''} * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in bases]
    return spark.sql("WITH " + ",\n".join([*heads, ctes.removeprefix("WITH ")]) + main)


def duckdb_sql(main: str, extra: dict[str, str] | None = None) -> str:
    """A complete DuckDB statement for ``main`` over the derived views."""
    return with_clause(main, "duckdb", extra).replace("WITH ", "WITH RECURSIVE ", 1) + main
