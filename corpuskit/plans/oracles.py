"""The same results in DuckDB SQL, written relationally and apart from the Spark plans."""

from __future__ import annotations

from ..functions.base import WS, WS_CHARS
from .fixtures import DEFAULT_NARRATOR, NARRATORS, duckdb_sql

STAMP = "20240201T000000Z"
_KEYS = ", ".join(f"'{n[0]}'" for n in NARRATORS)


def _strip(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def _prose(x: str) -> str:
    s = _strip(x)
    return (
        rf"(length({s}) >= 60 AND regexp_matches({s}, '\p{{Ll}}') AND NOT regexp_matches({s}, '\p{{Nd}}$')"
        rf" AND len(regexp_extract_all({s}, '\b\d{{1,3}}\b')) <= 1)"
    )


def _gap_prose(x: str) -> str:
    s = _strip(x)
    return rf"(length({s}) >= 60 AND regexp_matches({s}, '\p{{Ll}}') AND NOT regexp_matches({s}, '\p{{Nd}}$'))"


def _banners(x: str) -> str:
    def banner(word: str) -> str:
        return rf"\*\*\*[{WS}]*{word}[{WS}]+OF[{WS}]+TH(?:E|IS)[{WS}]+PROJECT[{WS}]+GUTENBERG.*?\*\*\*"

    cut_head = f"regexp_replace({x}, '(?is)^.*?{banner('START')}', '')"
    return f"regexp_replace({cut_head}, '(?is){banner('END')}.*$', '')"


def _citations(x: str) -> str:
    return rf"regexp_replace({x}, '\[\d+(?:[{WS}]*[,–-][{WS}]*\d+)*\]', '', 'g')"


def _urls(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)https?://[^{WS}]+|\bdoi:[{WS}]*[^{WS}]+|\b10\.\d{{4,}}/[^{WS}]+', '', 'g')"


def _abbreviations(x: str) -> str:
    for short, long in (
        (r"e\.g\.", "for example"), (r"i\.e\.", "that is"), (r"et al\.", "and colleagues"),
        (r"cf\.", "compare"), (r"Fig\.", "Figure"), (r"vs\.", "versus"),
    ):
        x = rf"regexp_replace({x}, '(?i)\b{short}', '{long}', 'g')"
    return x


_ROMAN_WORD = (
    r"(?i)^[.,:;()\[\]*]*m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[.,:;()\[\]*]*$"
)


def _romans(x: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> ''),"
        f" lambda w: CASE WHEN regexp_matches(w, '{_ROMAN_WORD}') THEN upper(w) ELSE w END), ' ')"
    )


def _titlecase(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    return _romans(
        f"array_to_string(list_transform({runs}, lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
    )


def _clean_title(x: str) -> str:
    flat = f"rtrim({_strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")}, '.')"
    short = f"regexp_replace(substr({flat}, 1, 96), ' [^ ]*$', '') || '…'"
    return _romans(f"(CASE WHEN length({flat}) > 96 THEN {short} ELSE {flat} END)")


def _packed(items: str) -> str:
    """Greedy packing of a list as a struct (o: finished pieces, c: open piece)."""
    return (
        f"list_reduce(list_transform({items}, lambda s: {{'o': []::varchar[], 'c': s}}),"
        " lambda a, p: CASE WHEN a.c <> '' AND length(a.c) + length(p.c) + 1 > 1800"
        " THEN {'o': list_append(a.o, a.c), 'c': p.c}"
        " ELSE {'o': a.o, 'c': CASE WHEN a.c = '' THEN p.c ELSE a.c || ' ' || p.c END} END,"
        " {'o': []::varchar[], 'c': ''})"
    )


def _pieces(packed: str) -> str:
    return f"CASE WHEN {packed}.c = '' THEN {packed}.o ELSE list_append({packed}.o, {packed}.c) END"


def _sentences(x: str) -> str:
    flat = _strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
    return rf"string_split(regexp_replace({flat}, '([.!?])[{WS}]+', '\1' || chr(1), 'g'), chr(1))"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


_HEADING = (
    rf"(?i)^(?:(chapter|book|part|section|letter|essay|canto)[{WS}]+([0-9]+|[ivxlcdm]+)\b"
    rf"|(federalist)[{WS}]+no\.?[{WS}]*([0-9]+)\b)"
)
_LONE = rf"(?i)^(?:chapter|book|part|section|letter|essay|canto|federalist)[{WS}]*[.:]?$"


def _exploded(source: str) -> str:
    return (
        "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line, len(l) AS n"
        f" FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source}) split_text"
    )


def _chunk_rows(regions: str) -> str:
    return f"""
        SELECT doc_id, region_no, chapter_title, unnest({_pieces('p')}) AS text,
               unnest(range(len({_pieces('p')}))) AS pos
        FROM (SELECT doc_id, region_no, chapter_title, {_packed('pieces')} AS p
              FROM (SELECT doc_id, region_no, chapter_title, flatten(list_transform(
                      list_transform({_sentences('body')}, lambda s: {{'s': s, 'w': {_packed(_words('s'))}}}),
                      lambda t: CASE WHEN length(t.s) <= 1800 THEN [t.s]
                                WHEN t.w.c = '' THEN t.w.o ELSE list_append(t.w.o, t.w.c) END)) AS pieces
                    FROM {regions}) cut) packed"""


def _flags(t: str, last: str, noise: str, short: str) -> str:
    tests = [
        (f"length({t}) > 1800", "OVER-CAP"),
        (f"length({t}) < 120 AND NOT {last}", "STUBBY"),
        (f"{noise} > 0.12", "SYMBOL-HEAVY"),
        (f"{short} > 0.30", "GIBBERISH"),
        (rf"regexp_matches({t}, '\[\d+(?:[{WS},–-]+\d+)*\]')", "RESIDUAL-CITATION"),
        (rf"regexp_matches({t}, '(?i)https?://|\bdoi:')", "RESIDUAL-URL"),
        (f"regexp_matches({t}, '(?i)project gutenberg')", "GUTENBERG-RESIDUE"),
        (rf"regexp_matches({t}, '(?:\b[A-Za-z][{WS}]){{4,}}')", "OCR-SPACING"),
    ]
    each = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in tests)
    return f"array_to_string(list_filter([{each}], lambda f: f IS NOT NULL), '|')"


def _noise(t: str) -> str:
    readable = rf"[\p{{L}}\p{{N}}{WS}.,;:''\"!?()—–-]"
    return (
        f"CASE WHEN length({t}) = 0 THEN 1.0 ELSE length(regexp_replace({t}, '{readable}', '', 'g'))::DOUBLE"
        f" / length({t}) END"
    )


def _short(t: str) -> str:
    tokens = rf"list_filter({_words(t)}, lambda w: regexp_matches(w, '\p{{L}}'))"
    return (
        f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE len(list_filter({tokens}, lambda w: length(w) <= 2))::DOUBLE"
        f" / len({tokens}) END"
    )


_DIGITS = {
    "hundreds": "['','c','cc','ccc','cd','d','dc','dcc','dccc','cm']",
    "tens": "['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc']",
    "units": "['','i','ii','iii','iv','v','vi','vii','viii','ix']",
}

EXTRA: dict[str, str] = {
    "romans": f"""
        SELECT n AS num, repeat('m', CAST(n // 1000 AS INT)) || {_DIGITS['hundreds']}[n // 100 % 10 + 1]
               || {_DIGITS['tens']}[n // 10 % 10 + 1] || {_DIGITS['units']}[n % 10 + 1] AS roman
        FROM (SELECT unnest(range(1, 6000)) AS n) numbers""",
    "bt_banner": f"SELECT doc_id, page_count, {_banners('text')} AS text FROM book_text",
    "bt_lines": _exploded("bt_banner"),
    "bt_marks": f"""
        SELECT doc_id, line_no, line, {_prose('line')} AS prose,
               lead({_prose('line')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_prose,
               min(CASE WHEN line_no < greatest(1, n // 6) AND regexp_matches({_strip('line')},
                   '(?i)^(?:table[{WS}]+of[{WS}]+)?contents[{WS}]*[.,:;]*$') THEN line_no END)
                 OVER (PARTITION BY doc_id) AS contents
        FROM bt_lines""",
    "bt_front": """
        SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
        FROM (SELECT *, min(CASE WHEN line_no > contents AND prose AND next_prose THEN line_no END)
                          OVER (PARTITION BY doc_id) AS body FROM bt_marks) marked
        WHERE body IS NULL OR line_no < contents OR line_no >= body
        GROUP BY doc_id""",
    "bt_norm": f"SELECT doc_id, {_abbreviations(_urls(_citations('text')))} AS text FROM bt_refs",
    "norm_lines": _exploded("bt_norm"),
    "cand_raw": f"""
        SELECT doc_id, line_no,
               CASE WHEN regexp_matches(s, '{_HEADING}') THEN s
                    WHEN regexp_matches(s, '{_LONE}') AND regexp_matches(s || ' ' || nxt, '{_HEADING}') THEN s || ' ' || nxt
               END AS raw
        FROM (SELECT doc_id, line_no, {_strip('line')} AS s,
                     lead({_strip('line')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt
              FROM norm_lines WHERE {_strip('line')} <> '') filled""",
    "cands": f"""
        SELECT doc_id, line_no, type, coalesce(TRY_CAST(word AS BIGINT), num) AS num, raw
        FROM (SELECT *, lower(regexp_extract(raw, '{_HEADING}', 1) || regexp_extract(raw, '{_HEADING}', 3)) AS type,
                     lower(regexp_extract(raw, '{_HEADING}', 2) || regexp_extract(raw, '{_HEADING}', 4)) AS word
              FROM cand_raw WHERE raw IS NOT NULL) parsed
        LEFT JOIN romans ON word = roman
        WHERE coalesce(TRY_CAST(word AS BIGINT), num) IS NOT NULL""",
    "cand_gaps": f"""
        SELECT c.doc_id, c.line_no, c.type, c.num, c.raw,
               coalesce(sum(length(l.line)) FILTER (WHERE {_gap_prose('l.line')}), 0) AS gap
        FROM (SELECT *, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 1000000000) AS nxt FROM cands) c
        LEFT JOIN norm_lines l ON l.doc_id = c.doc_id AND l.line_no > c.line_no AND l.line_no < c.nxt
        GROUP BY ALL""",
    "survivors": """
        SELECT doc_id, line_no, type, num, raw FROM cand_gaps WHERE gap >= 600
        QUALIFY row_number() OVER (PARTITION BY doc_id, type, num ORDER BY line_no) = 1""",
    "run_groups": """
        SELECT doc_id, type, list(num ORDER BY line_no) AS nums, list(line_no ORDER BY line_no) AS lns
        FROM survivors GROUP BY doc_id, type""",
    "run_lengths": """
        SELECT doc_id, type, nums, lns, 0 AS i, []::BIGINT[] AS lens, []::BIGINT[] AS prevs FROM run_groups
        UNION ALL
        SELECT doc_id, type, nums, lns, i + 1,
               list_append(lens, best + 1),
               list_append(prevs, CASE WHEN best = 0 THEN 0 ELSE
                 list_filter(range(1, i + 1), lambda j: lens[j] = best AND nums[j] < nums[i + 1])[1] END)
        FROM (SELECT *, coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda j: nums[j] < nums[i + 1]),
                                                         lambda j: lens[j])), 0) AS best
              FROM run_lengths WHERE i < len(nums)) stepped""",
    "run_paths": """
        SELECT doc_id, type, lns, prevs, list_position(lens, list_max(lens)) AS cur FROM run_lengths WHERE i = len(nums)
        UNION ALL
        SELECT doc_id, type, lns, prevs, prevs[cur] FROM run_paths WHERE prevs[cur] > 0""",
    "bounds": """
        SELECT s.doc_id, s.line_no, s.type, s.num, s.raw
        FROM survivors s JOIN (SELECT doc_id, lns[cur] AS line_no FROM run_paths) p
          ON s.doc_id = p.doc_id AND s.line_no = p.line_no""",
    "region_parts": f"""
        SELECT l.doc_id, l.line_no, l.line, b.line_no IS NOT NULL AS opens, {_clean_title('b.raw')} AS title,
               c.line_no IS NOT NULL AND b.line_no IS NULL AS noise,
               count(b.line_no) OVER (PARTITION BY l.doc_id) AS n_bounds,
               count(b.line_no) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS part
        FROM norm_lines l LEFT JOIN bounds b ON l.doc_id = b.doc_id AND l.line_no = b.line_no
        LEFT JOIN cands c ON l.doc_id = c.doc_id AND l.line_no = c.line_no""",
    "regions": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS region_no, chapter_title, body
        FROM (SELECT doc_id, part, max(CASE WHEN opens THEN title END) AS chapter_title,
                     {_strip('string_agg(line, chr(10) ORDER BY line_no)')} AS body
              FROM region_parts WHERE n_bounds > 0 AND NOT noise GROUP BY doc_id, part
              HAVING {_strip('string_agg(line, chr(10) ORDER BY line_no)')} <> '') bodies
        UNION ALL
        SELECT doc_id, 0, NULL, string_agg(line, chr(10) ORDER BY line_no) FROM region_parts WHERE n_bounds = 0 GROUP BY doc_id""",
    "chunk_pieces": _chunk_rows("regions"),
    "chunk_rows": """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY region_no, pos) - 1 AS seg_order,
               CASE WHEN pos = 0 THEN chapter_title END AS chapter_title, text,
               row_number() OVER (PARTITION BY doc_id ORDER BY region_no DESC, pos DESC) = 1 AS is_last
        FROM chunk_pieces""",
    "doc_regions": "SELECT doc_id, 0 AS region_no, NULL AS chapter_title, text AS body FROM documents",
    "doc_pieces": _chunk_rows("doc_regions"),
    # --- layout
    "line_texts": f"""
        SELECT doc_id, page_no, block_no, line_no, {_strip("string_agg(text, '' ORDER BY span_no)")} AS line
        FROM spans WHERE block_type = 0 GROUP BY doc_id, page_no, block_no, line_no""",
    "block_texts": f"""
        SELECT doc_id, page_no, block_no, {_strip('folded.t')} AS text
        FROM (SELECT doc_id, page_no, block_no, list_reduce(
                list({{'t': line, 'h': false, 'f': false}} ORDER BY line_no),
                lambda a, p: CASE WHEN a.h THEN {{'t': a.t || p.t, 'h': false, 'f': false}}
                  ELSE {{'t': a.t || CASE WHEN a.f THEN '' ELSE ' ' END
                          || CASE WHEN p.t[-1:] = '-' THEN p.t[:-2] ELSE p.t END, 'h': p.t[-1:] = '-', 'f': false}} END,
                {{'t': '', 'h': false, 'f': true}}) AS folded
              FROM line_texts WHERE line <> '' GROUP BY doc_id, page_no, block_no) reduced
        WHERE {_strip('folded.t')} <> ''""",
    "sizes": f"""
        SELECT doc_id, page_no, block_no, CAST(round_even(size, 0) AS INT) AS size,
               row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no, line_no, span_no) AS pos
        FROM spans WHERE block_type = 0 AND {_strip('text')} <> ''""",
    "page_bodies": """
        SELECT doc_id, page_no, arg_max(size, (n, -first_pos)) AS body
        FROM (SELECT doc_id, page_no, size, count(*) AS n, min(pos) AS first_pos FROM sizes GROUP BY ALL) tallied
        GROUP BY doc_id, page_no""",
    "block_sizes": """
        SELECT doc_id, page_no, block_no, arg_max(size, (n, -first_pos)) AS size
        FROM (SELECT doc_id, page_no, block_no, size, count(*) AS n, min(pos) AS first_pos FROM sizes GROUP BY ALL) tallied
        GROUP BY doc_id, page_no, block_no""",
    "all_pages": "SELECT DISTINCT doc_id, page_no FROM spans",
    "blocks": rf"""
        SELECT t.doc_id, t.page_no, t.block_no, t.text, s.size, b.body, y_center, page_h,
               (y_center < page_h * 0.08 OR y_center > page_h * 0.92) AND length(t.text) < 80 AS margin,
               regexp_matches(t.text, '^[\d{WS}\-–—|·•ivxlcdmIVXLCDM]+$') AND length(t.text) < 25 AS number,
               regexp_matches(t.text, '(?i)^(?:page[{WS}]+)?\d+[{WS}]+of[{WS}]+\d+\.?$') AS counter,
               s.size < b.body * 0.85 AND y_center > page_h * 0.65 AS footnote,
               CASE WHEN s.size > b.body * 1.2 THEN chr(10) || CASE WHEN t.text = upper(t.text)
                      THEN {_titlecase('t.text')} ELSE t.text END || '.' || chr(10) ELSE t.text END AS shown
        FROM block_texts t JOIN block_sizes s USING (doc_id, page_no, block_no) JOIN page_bodies b USING (doc_id, page_no)
        JOIN (SELECT doc_id, page_no, block_no, (min(y0) + max(y1)) / 2 AS y_center, max(page_h) AS page_h
              FROM spans GROUP BY ALL) g USING (doc_id, page_no, block_no)""",
    "page_texts": """
        SELECT p.doc_id, p.page_no, coalesce(string_agg(b.shown, chr(10) ORDER BY b.block_no), '') AS text
        FROM all_pages p LEFT JOIN blocks b ON p.doc_id = b.doc_id AND p.page_no = b.page_no
          AND NOT (b.margin OR b.number OR b.counter OR b.footnote)
        GROUP BY p.doc_id, p.page_no""",
    "doc_texts": """
        SELECT doc_id, count(*) AS page_count,
               coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE text <> ''), '') AS text
        FROM page_texts GROUP BY doc_id""",
    # --- catalog
    "progress_by_book": """
        SELECT b.id, b.status, b.tts_narrator, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, coalesce(error, 0) AS error
        FROM books b LEFT JOIN (SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready,
                                       count(*) FILTER (WHERE status = 'error') AS error FROM segments GROUP BY book_id) s
          ON b.id = s.book_id""",
    "admin_table": """
        SELECT b.id, title, author, b.status, genre, year, hidden, page_count, created_at, email AS owner_email,
               total AS segments_total, ready AS segments_ready, error AS segments_error
        FROM books b LEFT JOIN users u ON b.uploaded_by = u.id JOIN progress_by_book p ON p.id = b.id""",
    "ready_takes": """
        SELECT book_id, narrator, count(*) AS n FROM segment_audio a JOIN segments s ON a.segment_id = s.id
        WHERE a.status = 'ready' GROUP BY book_id, narrator""",
    "voice_rows": f"""
        SELECT p.id AS book_id, 0 AS pos, coalesce(nullif(tts_narrator, ''), '{DEFAULT_NARRATOR}') AS narrator, n.label, n.voice,
               true AS "primary", total > 0 AND ready = total AS ready, ready AS segments_ready, total AS segments_total
        FROM progress_by_book p JOIN narrators n
          ON n.key = CASE WHEN tts_narrator IN ({_KEYS}) THEN tts_narrator ELSE '{DEFAULT_NARRATOR}' END
        UNION ALL
        SELECT p.id, n.pos + 1, n.key, n.label, n.voice, false, p.ready > 0 AND t.n >= p.ready, least(t.n, p.ready), p.ready
        FROM ready_takes t JOIN progress_by_book p ON p.id = t.book_id JOIN narrators n ON n.key = t.narrator
        WHERE t.narrator <> coalesce(nullif(tts_narrator, ''), '{DEFAULT_NARRATOR}')""",
    "ready_segs": """
        SELECT book_id, id, duration, nullif(chapter_title, '') AS title,
               row_number() OVER (PARTITION BY book_id ORDER BY seg_order) - 1 AS idx,
               count(*) OVER (PARTITION BY book_id) AS n
        FROM segments WHERE status = 'ready'""",
    "doomed": "SELECT id AS book_id FROM books WHERE status = 'legacy'",
    "asked": """
        SELECT c_custkey AS book_id, CASE c_custkey % 4 WHEN 0 THEN c_name || '.PDF' WHEN 1 THEN c_name || '.txt' END AS new_file
        FROM customer""",
    "decided": """
        SELECT a.book_id, new_file, CASE WHEN new_file IS NOT NULL THEN lower(new_file) LIKE '%.pdf'
               ELSE i.key IS NOT NULL END AS accepted
        FROM asked a JOIN books b ON a.book_id = b.id LEFT JOIN (SELECT DISTINCT key FROM inventory) i ON i.key = pdf_path""",
    "planned": "SELECT book_id, id AS segment_id, seg_order, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status FROM segments WHERE status <> 'ready'",
    "classified": """
        SELECT host, seen_at, CASE WHEN mem_pct >= 92 OR swap_pct >= 80 OR per_cpu >= 3.0 THEN 'critical'
                              WHEN mem_pct >= 80 OR swap_pct >= 50 OR per_cpu >= 1.5 THEN 'warn' ELSE 'ok' END AS severity,
               list_filter([CASE WHEN mem_pct >= 80 THEN 'memory at ' || CAST(mem_pct AS VARCHAR) || '%' END,
                            CASE WHEN swap_pct >= 50 THEN 'swap at ' || CAST(swap_pct AS VARCHAR) || '%' END,
                            CASE WHEN per_cpu >= 1.5 THEN 'load ' || CAST(per_cpu AS VARCHAR) || 'x per cpu' END],
                           lambda r: r IS NOT NULL) AS reasons
        FROM (SELECT *, CAST(printf('%.2f', load1 / cpus) AS DOUBLE) AS per_cpu FROM host_metrics) loaded""",
    "latest_hosts": "SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY host ORDER BY seen_at DESC) = 1",
    "islands": """
        SELECT host, seen_at, sum(opens) OVER (PARTITION BY host ORDER BY seen_at) AS session
        FROM (SELECT host, seen_at, CASE WHEN seen_at - lag(seen_at) OVER (PARTITION BY host ORDER BY seen_at) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END
                AS opens FROM beats) marked""",
    "alive": """
        SELECT host, min(seen_at) AS alive_from, max(seen_at) + INTERVAL 120 SECOND AS alive_until, count(*) AS beats
        FROM islands GROUP BY host, session""",
    "good_votes": """
        SELECT v.* FROM ab_votes v JOIN ab_tests t ON v.ab_test_id = t.id AND t.published WHERE choice = 'no_diff'
          OR EXISTS (SELECT 1 FROM ab_options o WHERE o.ab_test_id = v.ab_test_id AND o.key = v.choice)""",
    "one_vote": """
        SELECT ab_test_id, user_id, arg_max(choice, (created_at, id)) AS choice, min(created_at) AS created_at,
               max(created_at) AS voted_at FROM good_votes GROUP BY ab_test_id, user_id""",
    "grid_lists": f"""
        SELECT id, provider, takes, list_filter(list_transform(string_split(voices, ','), lambda v: trim(v)), lambda v: v <> '') AS vs,
               list_filter(list_transform(string_split(presets, ','), lambda v: trim(v)), lambda v: v <> '') AS ps
        FROM grid_requests""",
    "grid_cells": f"""
        SELECT id, provider, v || '__' || p AS name, v || ' / ' || p AS label, take,
               v || '__' || p || CASE WHEN take > 1 THEN '__take' || CAST(take AS VARCHAR) ELSE '' END
                 || CASE WHEN provider = 'gemini' THEN '.wav' ELSE '.mp3' END AS filename
        FROM (SELECT *, unnest(range(1, takes + 1)) AS take
              FROM (SELECT *, unnest(ps) AS p FROM (SELECT *, unnest(vs) AS v FROM grid_lists
                    WHERE id NOT IN (SELECT id FROM (SELECT id, unnest(ps) AS p FROM grid_lists) n
                      WHERE p NOT IN (SELECT key FROM grid_presets))) a) b) c""",
    "grid_results": """
        SELECT c.id, c.provider, c.filename, CASE WHEN take < 3 AND length(filename) % 4 = 0 THEN 'failed' END AS error,
               provider IN ('openai', 'elevenlabs') AS has_key,
               provider IN ('openai', 'elevenlabs') AND take < 3 AND length(filename) % 4 <> 0 AS ok
        FROM grid_cells c""",
    "candidates_for_polish": """
        SELECT doc_id, seg_order, text, CASE (seg_order + doc_id) % 5 WHEN 0 THEN text || ' ' || text WHEN 1 THEN NULL
                 WHEN 2 THEN '  ' ELSE ' ' || replace(text, '[7–9]', '') || '. ' END AS cleaned FROM chunk_rows""",
    "called": f"""
        SELECT doc_id, seg_order, CASE WHEN keep THEN cand ELSE text END AS text, keep OR blank AS used
        FROM (SELECT *, NOT blank AND coalesce(cand <> '' AND abs(length(cand) - length(text))::DOUBLE / greatest(length(text), 1) <= 0.35, false)
                AS keep
              FROM (SELECT doc_id, seg_order, text, {_strip('text')} = '' AS blank,
                      CASE WHEN length(text) % 7 <> 0 THEN {_strip("replace(text, 'things', 'matters')")} END AS cand
                    FROM chunk_rows) c) d""",
    "polished": f"""
        SELECT doc_id, seg_order, CASE WHEN keep THEN cand ELSE text END AS text, keep OR blank AS used
        FROM (SELECT *, NOT blank AND coalesce(cand <> '' AND abs(length(cand) - length(text))::DOUBLE / greatest(length(text), 1) <= 0.35, false)
                AS keep
              FROM (SELECT *, {_strip('cleaned')} AS cand, {_strip('text')} = '' AS blank FROM candidates_for_polish) c) d""",
    "reports": f"""
        SELECT d.doc_id, page_count AS pages, coalesce(segments, 0) AS segments, coalesce(chapters, 0) AS chapters,
               coalesce(total, 0) AS total, coalesce("min", 0) AS "min", coalesce("max", 0) AS "max",
               coalesce(total // segments, 0) AS mean, coalesce(total, 0) // page_count AS per_page, coalesce(flagged, 0) AS flagged,
               coalesce(total, 0) < 1500 OR coalesce(total, 0)::DOUBLE / page_count < 200 AS scanned
        FROM book_text d LEFT JOIN (
          SELECT doc_id, count(*) AS segments, count(nullif(chapter_title, '')) AS chapters, sum(length(text)) AS total,
                 min(length(text)) AS "min", max(length(text)) AS "max",
                 count(*) FILTER (WHERE {_flags('text', 'is_last', _noise('text'), _short('text'))} <> '') AS flagged
          FROM chunk_rows GROUP BY doc_id) c ON d.doc_id = c.doc_id""",
}


def _strip_refs(source: str) -> str:
    heading = r"(?i)^(?:references|bibliography|works cited)\.?$"
    return f"""
        SELECT t.doc_id, CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, CAST(cut AS INT)) END AS text
        FROM {source} t LEFT JOIN (
          SELECT o.doc_id, min(start) AS cut
          FROM (SELECT doc_id, line, coalesce(max(CASE WHEN {_strip('line')} <> '' THEN after END)
                         OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS after
                      FROM ({_exploded(source)}) e) offsets) o
          JOIN {source} w ON w.doc_id = o.doc_id
          WHERE regexp_matches({_strip('line')}, '{heading}') AND start >= length(w.text) * 0.7::DOUBLE
          GROUP BY o.doc_id) c ON c.doc_id = t.doc_id"""


EXTRA["bt_refs"] = _strip_refs("bt_front")
EXTRA["raw_lines"] = _exploded("book_text")


def _blocks_without(rule: str) -> str:
    return f"SELECT doc_id, page_no, block_no FROM blocks WHERE NOT {rule}"


def _text(x: str, source: str = "book_text") -> str:
    return f"SELECT doc_id, {x} AS text FROM {source}"


_CLOCK = "CASE WHEN event_id % 13 > 0 THEN value * 17 - 20 END"
_UP = "CASE WHEN event_id % 13 > 0 THEN value * event_id % 400000 END"
_LABELLED = "('ab_tests/' || CAST(id AS VARCHAR) || '.mp3')"

ORACLES: dict[str, str] = {
    # sources and sinks
    "read_catalog": "SELECT * FROM books",
    "copy_table": "SELECT count(*) AS rows_copied, sum(length(text)) AS chars, bit_xor(('0x' || substr(md5(text), 1, 8))::BIGINT) AS text_xor FROM book_text",
    "remap_ids": """
        SELECT id + 2000 AS id, book_id + 2 AS book_id, seg_order, text,
               CASE WHEN audio_path LIKE '%storage/audio%' THEN CASE WHEN audio_path IN (SELECT key FROM inventory)
                 THEN 'audio/' || CAST(book_id + 2 AS VARCHAR) || '/' || printf('%04d', seg_order) || '.mp3' END
               ELSE audio_path END AS audio_path, status, duration
        FROM segments""",
    "remap_counts": """
        SELECT count(*) FILTER (WHERE here AND NOT there) AS uploaded, count(*) FILTER (WHERE here AND there) AS skipped,
               count(*) FILTER (WHERE NOT here) AS missing
        FROM (SELECT audio_path IN (SELECT key FROM inventory) AS here,
                     'audio/' || CAST(book_id + 2 AS VARCHAR) || '/' || printf('%04d', seg_order) || '.mp3' IN (SELECT key FROM inventory) AS there
              FROM segments WHERE audio_path LIKE '%storage/audio%') clips""",
    "remap_books": "SELECT id + 2 AS id, title, status FROM books",
    "backfill_owner": """
        SELECT id, coalesce(uploaded_by, (SELECT min(id) FROM users WHERE lower(email) = 'customer#000000007@example.org')) AS uploaded_by
        FROM books""",
    "rekey_prefix": f"""
        SELECT key, CASE WHEN starts_with(key, 'audio/13/') THEN 'audio-archive/13/{STAMP}/' || substr(key, 10) ELSE key END AS new_key,
               starts_with(key, 'audio/13/') AS moved FROM inventory""",
    "purge_prefixes": """
        SELECT key, book_id FROM inventory JOIN doomed ON split_part(key, '/', 2) = CAST(book_id AS VARCHAR)
        WHERE starts_with(key, 'audio/' || CAST(book_id AS VARCHAR) || '/')
           OR starts_with(key, 'audio-archive/' || CAST(book_id AS VARCHAR) || '/')
           OR starts_with(key, 'pdfs/' || CAST(book_id AS VARCHAR) || '/')""",
    "list_inventory": """
        SELECT doc_id % 40 AS book_id, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, count(DISTINCT coalesce(lang, 'none')) AS folders,
               doc_id % 40 % 3 = 0 AS purged, doc_id % 40 = 13 AS moved
        FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id % 40""",
    "purge_narrator": """
        SELECT key, book_id FROM inventory JOIN doomed ON split_part(key, '/', 2) = CAST(book_id AS VARCHAR)
        WHERE starts_with(key, 'audio/' || CAST(book_id AS VARCHAR) || '/alder/')""",
    "write_segments": """
        SELECT book_id, seg_order, CASE WHEN hit THEN 'pending' ELSE status END AS status, length(text) AS chars
        FROM (SELECT *, bool_or(status = 'ready') OVER (PARTITION BY book_id) AS hit FROM segments) s
        WHERE NOT hit OR status = 'ready'""",
    "write_report": "SELECT * FROM reports",
    "orphaned_takes": """
        SELECT a.id, a.segment_id FROM segment_audio a JOIN segments s ON a.segment_id = s.id
        WHERE s.book_id IN (SELECT book_id FROM doomed)""",
    # layout
    "body_size": "SELECT doc_id, page_no, body AS body_size FROM all_pages LEFT JOIN page_bodies USING (doc_id, page_no)",
    "block_text": "SELECT doc_id, page_no, block_no, text FROM block_texts",
    "dominant_size": "SELECT doc_id, page_no, block_no, size FROM blocks",
    "drop_running_margins": _blocks_without("margin"),
    "drop_page_numbers": _blocks_without("number"),
    "drop_page_counters": _blocks_without("counter"),
    "drop_footnotes": _blocks_without("footnote"),
    "format_headings": "SELECT doc_id, page_no, block_no, shown AS text FROM blocks",
    "page_text": "SELECT doc_id, page_no, text FROM page_texts",
    "doc_text": "SELECT doc_id, page_count, text FROM doc_texts",
    # normalization
    "nfkc": "SELECT doc_id, text FROM documents",
    "strip_banners": _text("text", "bt_banner"),
    "strip_front_matter": _text("text", "bt_front"),
    "strip_references": _strip_refs("book_text"),
    "strip_citations": _text(_citations("text")),
    "strip_urls": _text(_urls("text")),
    "expand_abbreviations": _text(_abbreviations("text")),
    "normalize_text": _text("text", "bt_norm"),
    "is_prose_line": f"SELECT doc_id, line_no, {_prose('line')} AS prose FROM raw_lines",
    "smart_titlecase": f"SELECT doc_id, line_no, {_titlecase("upper(replace(line, 'ß', 'ss'))")} AS title FROM raw_lines",
    "chapter_number": r"""
        SELECT doc_id, line_no, word, coalesce(TRY_CAST(CASE WHEN regexp_matches(word, '^[0-9]+$') THEN word END AS BIGINT), num) AS num
        FROM (SELECT DISTINCT doc_id, line_no, unnest(regexp_split_to_array(line, '[\s.]+')) AS word FROM raw_lines) w
        LEFT JOIN romans ON lower(word) = roman
        WHERE coalesce(TRY_CAST(CASE WHEN regexp_matches(word, '^[0-9]+$') THEN word END AS BIGINT), num) IS NOT NULL""",
    "heading_candidates": "SELECT * FROM cands",
    "body_gap": "SELECT doc_id, line_no, gap FROM cand_gaps",
    "filter_by_gap": "SELECT doc_id, line_no, type, num FROM cand_gaps WHERE gap >= 600",
    "dedup_headings": "SELECT doc_id, line_no, type, num FROM survivors",
    "longest_increasing_run": "SELECT doc_id, line_no, type, num FROM bounds",
    "clean_title": f"SELECT doc_id, line_no, {_clean_title('line')} AS title FROM raw_lines",
    "segment_chapters": "SELECT doc_id, region_no, chapter_title, body FROM regions",
    "split_sentences": f"""
        SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence
        FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents) s""",
    "split_oversized": f"""
        SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS piece
        FROM (SELECT doc_id, CASE WHEN length(text) <= 1800 THEN [text] ELSE {_pieces('p')} END AS l
              FROM (SELECT doc_id, text, {_packed(_words('text'))} AS p FROM documents) s) t""",
    "pack_chunks": "SELECT doc_id, pos, text AS piece FROM doc_pieces",
    "pack_rows": "SELECT doc_id, pos, text AS piece FROM doc_pieces",
    "emit_chunks": "SELECT doc_id, seg_order, chapter_title, text FROM chunk_rows",
    "prepare_corpus": f"""
        SELECT doc_id, seg_order, chapter_title, text, {_flags('text', 'is_last', _noise('text'), _short('text'))} AS flags
        FROM chunk_rows""",
    "looks_scanned": """
        SELECT doc_id, length(text) < 1500 OR (doc_id % 9 > 0 AND length(text)::DOUBLE / (page_count * (doc_id % 9)) < 200) AS scanned
        FROM book_text""",
    "polish_guard": "SELECT doc_id, seg_order, text, used FROM polished",
    "polish_calls": "SELECT doc_id, seg_order, text, used FROM called",
    "polish_guard_table": "SELECT doc_id, seg_order, text, used FROM polished",
    "fallback_report": "SELECT doc_id, count(*) FILTER (WHERE NOT used) AS fallbacks, count(*) AS total FROM polished GROUP BY doc_id",
    "fallback_events": """
        SELECT doc_id AS book_id, 'ingest_book' AS task, 'warning' AS level, CAST(count(*) FILTER (WHERE NOT used) AS VARCHAR) || '/'
               || CAST(count(*) AS VARCHAR) || ' chunks kept heuristic text (LLM polish unavailable).' AS message
        FROM polished GROUP BY doc_id HAVING count(*) FILTER (WHERE NOT used) > 0""",
    "apply_polish": "SELECT doc_id, seg_order, replace(text, 'things', 'matters') AS cleaned FROM chunk_rows",
    "qa_flags": f"""
        SELECT doc_id, {_flags('text', '(doc_id % 4 = 0)', _noise('text'), _short('text'))} AS flags, length(text)::INT AS length,
               round({_noise('text')}, 6) AS noise_ratio, round({_short('text')}, 6) AS short_ratio FROM documents""",
    "duplicate_orders": "SELECT book_id, seg_order, count(*) AS n FROM segment_log GROUP BY book_id, seg_order HAVING count(*) > 1",
    "extract_report": "SELECT * FROM reports",
    "scanned_events": """
        SELECT doc_id AS book_id, 'ingest_book' AS task, 'warning' AS level, 'Looks scanned: only ' || CAST(total AS VARCHAR)
               || ' chars across ' || CAST(pages AS VARCHAR) || ' pages — likely needs OCR.' AS message FROM reports WHERE scanned""",
    "review_summary": """
        SELECT b.id AS book_id, coalesce(n, 0) AS segments, coalesce(chars, 0) AS chars,
               coalesce(page_count, 0) > 0 AND coalesce(chars, 0)::DOUBLE / page_count < 200 AS likely_scanned
        FROM books b LEFT JOIN (SELECT book_id, count(*) AS n, sum(length(text)) AS chars FROM segments GROUP BY book_id) s ON b.id = s.book_id""",
    # catalog
    "status_summary": """
        SELECT status, coalesce(n, 0) AS n FROM (SELECT unnest(['pending','processing','review','synthesizing','complete','error']) AS status) k
          FULL JOIN (SELECT status, count(*) AS n FROM books GROUP BY status) c USING (status)
        UNION ALL SELECT 'total', count(*) FROM books""",
    "segment_progress": """
        SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready,
               count(*) FILTER (WHERE status = 'error') AS error FROM segments GROUP BY book_id""",
    "admin_books": "SELECT * FROM admin_table ORDER BY created_at DESC, id DESC",
    "visible_books": "SELECT id, title, hidden, created_at FROM books WHERE NOT hidden ORDER BY created_at DESC, id DESC",
    "search_books": """
        SELECT id, title, author FROM books WHERE coalesce(nullif(genre, ''), 'Uncategorized') = 'Uncategorized'
          AND (contains(lower(title), '#00000010') OR contains(lower(author), '#00000010'))""",
    "search_needles": """
        SELECT DISTINCT query, id FROM books JOIN (
          SELECT right(c_name, 6) AS query FROM customer UNION SELECT ' K ' || CAST(c_custkey % 1000 AS VARCHAR) || ' ' FROM customer
          UNION SELECT right(c_name, 2) FROM customer WHERE c_custkey % 100 = 7 UNION SELECT '  ') wanted
          ON trim(query) <> '' AND (contains(lower(title), lower(trim(query))) OR contains(lower(author), lower(trim(query))))""",
    "genre_facets": """
        SELECT coalesce(nullif(genre, ''), 'Uncategorized') AS genre, count(*) AS n FROM books GROUP BY 1
        UNION ALL SELECT 'All', count(*) FROM books""",
    "sort_books": """
        SELECT id, segments_ready, segments_total FROM admin_table
        ORDER BY CASE WHEN segments_total > 0 THEN segments_ready / segments_total ELSE -1 END DESC, id""",
    "alt_ready_counts": "SELECT * FROM ready_takes",
    "resolve_narrator": f"""
        SELECT b.id, n.key AS preset, coalesce(n.provider, 'openai') AS provider, n.label, n.voice,
               nullif(tts_instructions, '') AS instructions_override
        FROM books b JOIN narrators n ON n.key = CASE WHEN tts_narrator IN ({_KEYS}) THEN tts_narrator ELSE '{DEFAULT_NARRATOR}' END""",
    "narrations": "SELECT * FROM voice_rows",
    "library_list": """
        SELECT b.id, b.title, string_agg(narrator || ':' || label || ':' || CAST(ready AS VARCHAR), '|' ORDER BY pos, narrator) AS voices
        FROM books b JOIN voice_rows v ON v.book_id = b.id WHERE NOT hidden GROUP BY b.id, b.title""",
    "resolve_take": """
        SELECT s.id AS segment_id, coalesce(nullif(a.audio_path, ''), s.audio_path) AS path
        FROM segments s LEFT JOIN segment_audio a ON a.segment_id = s.id AND a.narrator = 'alder' AND a.status = 'ready'""",
    "card_state": """
        SELECT id AS book_id, ready, error AS failed, CASE WHEN total > 0 THEN ready / total ELSE 0.0 END AS progress,
               status = 'complete' OR (status = 'synthesizing' AND ready > 0) AS playable,
               status = 'synthesizing' AND error > 0 AS stuck, status IN ('pending', 'processing') AS working,
               status IN ('pending', 'processing', 'synthesizing') AS busy, 'Play' AS action
        FROM progress_by_book""",
    "first_segment_excerpt": "SELECT book_id, substr(arg_min(text, seg_order), 1, 600) AS excerpt FROM segments GROUP BY book_id",
    "parse_metadata": """
        SELECT id, CASE event_k WHEN 0 THEN 'Ann' WHEN 4 THEN event_type WHEN 5 THEN event_type END AS author,
               CASE event_k WHEN 1 THEN 'Fiction' WHEN 3 THEN 'History' WHEN 6 THEN event_type END AS genre,
               CASE event_k WHEN 0 THEN 1999 WHEN 2 THEN 1999 WHEN 5 THEN 1900 + user_id WHEN 6 THEN 1900 + user_id END AS year,
               CASE event_k WHEN 0 THEN 'n' WHEN 2 THEN 'two words' END AS notes
        FROM (SELECT event_id AS id, event_id % 7 AS event_k, event_type, user_id FROM events) e""",
    "apply_patch": """
        SELECT b.id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE title END AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE genre END AS genre,
               CASE WHEN c_custkey % 5 = 0 THEN true ELSE hidden END AS hidden, status
        FROM books b LEFT JOIN customer ON b.id = c_custkey * 3""",
    "edit_segments": """
        SELECT s.id, CASE WHEN c_custkey IS NULL THEN status ELSE 'pending' END AS status, md5(coalesce(c_name, text)) AS text_md5
        FROM segments s LEFT JOIN customer ON book_id = c_custkey AND seg_order = 2""",
    "chapter_marks": "SELECT book_id, idx, title FROM ready_segs WHERE title IS NOT NULL",
    "position_label": """
        SELECT book_id, idx, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx),
               'Part ' || CAST(idx + 1 AS VARCHAR) || ' of ' || CAST(n AS VARCHAR)) AS label FROM ready_segs""",
    "listening_fraction": """
        SELECT id, round(f, 6) AS fraction, coalesce(f > 0.01 AND f < 0.995, false) AS started
        FROM (SELECT p.id, (TRY_CAST(seg_idx AS INT) + coalesce(t / nullif(duration, 0), 0)) / n_ready AS f
              FROM progress p LEFT JOIN ready_segs s ON s.book_id = p.book_id AND s.idx = TRY_CAST(seg_idx AS INT)
              LEFT JOIN (SELECT book_id, nullif(count(*) FILTER (WHERE status = 'ready'), 0) AS n_ready FROM segments GROUP BY book_id) r
                ON r.book_id = p.book_id) x""",
    "resume_position": """
        SELECT user_id, p.book_id, CASE WHEN valid THEN saved ELSE 0 END AS idx, CASE WHEN valid THEN coalesce(t, 0.0) ELSE 0.0 END AS t
        FROM (SELECT *, coalesce(saved >= 0 AND saved < n_ready, false) AS valid
              FROM (SELECT user_id, book_id, t, TRY_CAST(seg_idx AS INT) AS saved FROM progress
                    QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY updated DESC, id DESC) = 1) q
              LEFT JOIN (SELECT book_id AS b, count(*) FILTER (WHERE status = 'ready') AS n_ready FROM segments GROUP BY book_id) r
                ON r.b = q.book_id) p""",
    "initial_narrator": """
        SELECT user_id, s.book_id, CASE WHEN o.narrator IS NOT NULL THEN s.narrator ELSE f.first_voice END AS narrator
        FROM saved_voices s LEFT JOIN (SELECT book_id, narrator FROM voice_rows WHERE ready) o
          ON o.book_id = s.book_id AND o.narrator = s.narrator
        LEFT JOIN (SELECT book_id, arg_min(narrator, pos) AS first_voice FROM voice_rows WHERE ready GROUP BY book_id) f
          ON f.book_id = s.book_id""",
    "addable_narrators": """
        SELECT b.id AS book_id, n.key AS narrator FROM books b, narrators n
        WHERE b.status = 'complete' AND NOT EXISTS (SELECT 1 FROM voice_rows v WHERE v.book_id = b.id AND v.narrator = n.key)""",
    "ab_eligible_users": """
        SELECT id, email, role FROM users WHERE (role = 'admin' OR ab_test_access) AND (lower(email) = 'customer#000000100@example.org'
          OR lower(email) IN (SELECT 'customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') || '@example.org' FROM supplier))""",
    "allowed_sign_ins": """
        SELECT id, replace(email, 'customer', 'SUPPLIER') AS email FROM users
        WHERE id = 149 OR replace(lower(email), 'customer', 'supplier') IN (SELECT lower(s_name) || '@example.org' FROM supplier)""",
    "apply_access": """
        SELECT id, CASE WHEN s_suppkey IS NULL THEN ab_test_access ELSE s_suppkey % 2 = 0 END AS ab_test_access
        FROM users LEFT JOIN supplier ON id = s_suppkey""",
    "list_narrators": """
        SELECT key, label, voice, coalesce(provider, 'openai') AS provider, key = 'voice_3' AS is_default FROM presets""",
    "drop_narration": f"""
        SELECT a.id, a.segment_id, a.narrator FROM segment_audio a JOIN segments s ON a.segment_id = s.id JOIN books b ON b.id = s.book_id
        WHERE a.narrator <> 'willow' OR coalesce(nullif(b.tts_narrator, ''), '{DEFAULT_NARRATOR}') = 'willow'""",
    "delete_books": "SELECT id, status FROM books WHERE id NOT IN (SELECT book_id FROM doomed)",
    "delete_books_segments": "SELECT id, book_id FROM segments WHERE book_id NOT IN (SELECT book_id FROM doomed)",
    "delete_books_takes": """
        SELECT a.id, segment_id FROM segment_audio a JOIN segments s ON a.segment_id = s.id WHERE book_id NOT IN (SELECT book_id FROM doomed)""",
    "delete_books_events": """
        SELECT id, CASE WHEN book_id IN (SELECT book_id FROM doomed) THEN NULL ELSE book_id END AS book_id, level FROM pipeline_events""",
    "upsert_users": """
        SELECT id, google_id, email, display_name, CASE WHEN lower(email) = 'customer#000000015@example.org'
                 AND google_id IN (SELECT 'g' || CAST(user_id * 15 AS VARCHAR) FROM events) THEN 'admin' ELSE role END AS role, ab_test_access
        FROM users
        UNION ALL
        SELECT NULL, g, coalesce(email, ''), event_type, 'user', false
        FROM (SELECT 'g' || CAST(user_id * 15 AS VARCHAR) AS g, event_type,
                     CASE WHEN event_id % 3 > 0 THEN event_type || CAST(user_id AS VARCHAR) END AS email
              FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) firsts
        WHERE g NOT IN (SELECT google_id FROM users)""",
    "accept_uploads": """
        SELECT o_orderkey, o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.pdf.txt' END AS filename,
               o_orderkey % 3 < 2 AS accepted FROM orders""",
    # planning
    "plan_primary": "SELECT * FROM planned",
    "plan_alternate": """
        SELECT s.id AS segment_id, CASE WHEN a.id IS NULL THEN 'create' WHEN a.status = 'ready' AND nullif(a.audio_path, '') IS NOT NULL
               THEN 'skip' ELSE 'reset' END AS action
        FROM segments s LEFT JOIN segment_audio a ON a.segment_id = s.id AND a.narrator = 'willow' WHERE s.status = 'ready'""",
    "route": f"""
        SELECT segment_id, provider, CASE provider WHEN 'elevenlabs' THEN 'synth_el' ELSE 'synth' END AS queue
        FROM planned p JOIN books b ON b.id = p.book_id
        JOIN narrators n ON n.key = CASE WHEN tts_narrator IN ({_KEYS}) THEN tts_narrator ELSE '{DEFAULT_NARRATOR}' END""",
    "queue_load": f"""
        SELECT CASE provider WHEN 'elevenlabs' THEN 'synth_el' ELSE 'synth' END AS queue, count(*) AS n
        FROM planned p JOIN books b ON b.id = p.book_id
        JOIN narrators n ON n.key = CASE WHEN tts_narrator IN ({_KEYS}) THEN tts_narrator ELSE '{DEFAULT_NARRATOR}' END
        GROUP BY 1""",
    "output_keys": "SELECT segment_id, 'audio/' || CAST(book_id AS VARCHAR) || '/' || printf('%04d', seg_order) || '.mp3' AS key FROM planned",
    "output_keys_alternate": "SELECT id, 'audio/' || CAST(book_id AS VARCHAR) || '/willow/' || printf('%04d', seg_order) || '.mp3' AS key FROM segments",
    "finalize": "SELECT id AS book_id, CASE WHEN ready = total THEN 'complete' ELSE 'error' END AS status FROM progress_by_book",
    "can_narrate": f"""
        SELECT book_id, narrator, reason IS NULL AS ok, reason
        FROM (SELECT q.book_id, q.narrator, CASE WHEN b.id IS NULL THEN 'no such book' WHEN q.narrator NOT IN ({_KEYS}) THEN 'unknown narrator'
                WHEN q.narrator = coalesce(nullif(b.tts_narrator, ''), '{DEFAULT_NARRATOR}') THEN 'already the primary narrator'
                WHEN NOT EXISTS (SELECT 1 FROM segments s WHERE s.book_id = b.id AND s.status = 'ready') THEN 'no rendered audio' END AS reason
              FROM (SELECT p.book_id, CASE WHEN p.id % 6 = 0 THEN 'nobody' ELSE v.narrator END AS narrator
                    FROM progress p JOIN saved_voices v USING (user_id, book_id)) q LEFT JOIN books b ON b.id = q.book_id) r""",
    "fill_source": "SELECT id AS book_id, pdf_path, pdf_path IN (SELECT key FROM inventory) AS available FROM books",
    "classify_path": "SELECT key, CASE WHEN starts_with(key, 'storage/') THEN 'local' ELSE 'remote' END AS place FROM inventory",
    "plan_reprocess": "SELECT book_id, accepted FROM decided",
    "plan_reprocess_books": """
        SELECT b.id, coalesce(new_file, filename) AS filename,
               CASE WHEN new_file IS NULL THEN pdf_path ELSE 'pdfs/' || CAST(b.id AS VARCHAR) || '/' || new_file END AS pdf_path,
               'pending' AS status, CAST(NULL AS INT) AS page_count
        FROM books b JOIN decided d ON d.book_id = b.id WHERE accepted""",
    "plan_reprocess_segments": "SELECT id, book_id FROM segments WHERE book_id NOT IN (SELECT book_id FROM decided WHERE accepted)",
    "plan_reprocess_moves": f"""
        SELECT book_id, key, 'audio-archive/' || CAST(book_id AS VARCHAR) || '/{STAMP}/' || array_to_string(string_split(key, '/')[3:], '/') AS new_key
        FROM inventory JOIN decided ON split_part(key, '/', 2) = CAST(book_id AS VARCHAR) WHERE accepted AND split_part(key, '/', 1) = 'audio'""",
    "plan_reprocess_takes": """
        SELECT a.id, segment_id FROM segment_audio a WHERE segment_id NOT IN (
          SELECT s.id FROM segments s JOIN decided d ON s.book_id = d.book_id WHERE accepted)""",
    "plan_reprocess_purge": """
        SELECT key, book_id FROM inventory JOIN decided ON split_part(key, '/', 2) = CAST(book_id AS VARCHAR)
        WHERE accepted AND new_file IS NOT NULL AND split_part(key, '/', 1) = 'pdfs'""",
    # monitoring
    "record_events": """
        SELECT id, book_id, level, length(m) AS message_chars, md5(m) AS message_md5, length(substr(nullif(traceback, ''), 1, 16000)) AS traceback_chars
        FROM (SELECT *, substr(coalesce(message, ''), 1, 4000) AS m FROM pipeline_events) e""",
    "recent_events": """
        SELECT e.id, book_id, title AS book_title, task, level, e.created_at FROM pipeline_events e LEFT JOIN books b ON b.id = book_id
        WHERE level = 'error' ORDER BY e.created_at DESC, e.id DESC LIMIT 500""",
    "errors_only": """
        SELECT id, book_title, level FROM (SELECT e.id, title AS book_title, level FROM pipeline_events e LEFT JOIN books b ON b.id = book_id
          ORDER BY e.created_at DESC, e.id DESC LIMIT 100) r WHERE level = 'error'""",
    "classify_host": "SELECT host, seen_at, severity, array_to_string(reasons, '|') AS reasons FROM classified",
    "host_report": """
        SELECT *, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) OVER () WHEN 2 THEN 'critical' WHEN 1 THEN 'warn'
               ELSE 'ok' END AS overall
        FROM (SELECT h.host, l.host IS NOT NULL AS online, CAST(round_even(age, 0) AS BIGINT) AS age_s, coalesce(severity, 'warn') AS severity,
                     coalesce(array_to_string(reasons, '|'), 'no heartbeat in the last 2 minutes') AS reasons
              FROM (SELECT DISTINCT host FROM host_metrics UNION ALL SELECT 'idle-' || CAST(r_regionkey AS VARCHAR) FROM region) h
              LEFT JOIN (SELECT *, epoch((SELECT max(seen_at) FROM host_metrics)) - epoch(seen_at) AS age FROM latest_hosts) l
                ON l.host = h.host AND age < 120) r""",
    "critical_banner": """
        SELECT host || '@' || CAST(epoch_us(seen_at) AS VARCHAR) AS host,
               host || '@' || CAST(epoch_us(seen_at) AS VARCHAR) || ': ' || array_to_string(reasons, ', ') AS banner
        FROM classified WHERE severity = 'critical'""",
    "liveness_sessions": "SELECT * FROM alive",
    "outages": """
        SELECT * FROM (SELECT host, alive_until AS down_from, lead(alive_from) OVER (PARTITION BY host ORDER BY alive_from) AS back_at FROM alive) g
        WHERE back_at IS NOT NULL""",
    "parse_log": """
        SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
               'app.' || event_type AS logger, 'user ' || CAST(user_id AS VARCHAR) || ' sent: ' || props AS message FROM events""",
    "log_records": """
        SELECT 'user ' || CAST(user_id AS VARCHAR) || ' sent ' || CAST(event_id AS VARCHAR) || ': ' || props AS message,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
               strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS ts, 'app.' || event_type AS logger,
               CASE WHEN event_type = 'error' THEN 'Traceback (most recent call last):' || chr(10) || repeat('  File "a.py", line 3, in f' || chr(10), event_id % 5)
                    || chr(10) || 'ValueError: bad value at: ' || props END AS traceback,
               CASE WHEN event_type = 'error' THEN 4 + event_id % 5 ELSE 1 END AS lines
        FROM events""",
    "newest_by_day": """
        SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "tail_logs": "SELECT id, line FROM log_lines WHERE source = 'worker' ORDER BY seen_at DESC, id DESC LIMIT 200",
    "cap_log": "SELECT id, source FROM log_lines QUALIFY row_number() OVER (PARTITION BY source ORDER BY seen_at DESC, id DESC) <= 1000",
    "queue_depth": """
        SELECT coalesce(queue, 'total') AS queue, sum(n)::BIGINT AS n
        FROM (SELECT q.queue, count(i.id) AS n FROM (SELECT unnest(['synth', 'ingest', 'celery', 'synth_el', 'unused']) AS queue) q
              LEFT JOIN queue_items i USING (queue) GROUP BY q.queue) c GROUP BY ROLLUP (queue)""",
    "worker_rollup": """
        SELECT replace(worker, 'celery@', '') AS name, worker, count(*) FILTER (WHERE state = 'done') AS processed,
               count(*) FILTER (WHERE state = 'reserved') AS reserved, count(*) FILTER (WHERE state = 'active') AS active
        FROM work_items GROUP BY worker""",
    "worker_active": """
        SELECT id, replace(worker, 'celery@', '') AS name, coalesce(replace(task, 'app.tasks.', ''), '?') AS task,
               round(epoch((SELECT max(started) FROM work_items)) - epoch(started), 3) AS runtime_s
        FROM work_items WHERE state = 'active'""",
    "format_clock": f"""
        SELECT event_id, CASE WHEN s IS NULL OR s < 0 THEN '0:00' ELSE CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || ':'
               || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock
        FROM (SELECT event_id, {_CLOCK} AS s FROM events) e""",
    "format_uptime": f"""
        SELECT event_id, CASE WHEN n IS NULL THEN '—' WHEN n < 60 THEN printf('%ds', n) WHEN n < 3600 THEN printf('%dm %ds', n // 60, n % 60)
               WHEN n < 172800 THEN printf('%dh %dm', n // 3600, n % 3600 // 60) ELSE printf('%dd %dh', n // 86400, n // 3600 % 24) END AS uptime
        FROM (SELECT event_id, CAST(floor({_UP} + 0.5) AS BIGINT) AS n FROM events) e""",
    "failure_fallback": """
        SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE book_id END AS book_id, coalesce(task, 'unknown') AS task, 'error' AS level,
               coalesce(substr(message, 1, 20), 'Task failed') AS message, length(substr(nullif(traceback, ''), 1, 16000)) AS traceback
        FROM pipeline_events""",
    # votes
    "valid_votes": "SELECT * FROM good_votes",
    "upsert_votes": "SELECT * FROM one_vote",
    "vote_tally": """
        SELECT t.id AS test_id, title, published, t.created_at, count(*) FILTER (WHERE choice = 'A') AS "n_A",
               count(*) FILTER (WHERE choice = 'B') AS "n_B", count(*) FILTER (WHERE choice = 'no_diff') AS n_no_diff, count(v.id) AS total
        FROM ab_tests t LEFT JOIN ab_votes v ON v.ab_test_id = t.id GROUP BY t.id, title, published, t.created_at""",
    "vote_share": """
        SELECT test_id, CASE WHEN n > 0 THEN CAST(floor(a / n * 100 + 0.5) AS BIGINT) END AS pct_a,
               CASE WHEN n > 0 THEN CAST(floor(b / n * 100 + 0.5) AS BIGINT) END AS pct_b,
               CASE WHEN n > 0 THEN CAST(floor(d / n * 100 + 0.5) AS BIGINT) END AS pct_no_diff
        FROM (SELECT t.id AS test_id, count(v.choice) AS n, count(*) FILTER (WHERE choice = 'A') AS a, count(*) FILTER (WHERE choice = 'B') AS b,
                     count(*) FILTER (WHERE choice = 'no_diff') AS d FROM ab_tests t LEFT JOIN one_vote v ON v.ab_test_id = t.id GROUP BY t.id) c""",
    "tests_for_user": """
        SELECT u.user_id, t.id AS ab_test_id, title, t.created_at, opt_order, o.key, CASE WHEN v.choice IS NOT NULL THEN o.label END AS label,
               audio_key IS NOT NULL AS has_clip, v.choice AS my_vote, coalesce(v.choice = o.key, false) AS picked
        FROM (SELECT DISTINCT user_id, ab_test_id FROM ab_votes) u JOIN ab_tests t ON t.id = u.ab_test_id AND published
        JOIN ab_options o ON o.ab_test_id = t.id LEFT JOIN one_vote v ON v.ab_test_id = t.id AND v.user_id = u.user_id""",
    "render_grid": "SELECT * FROM grid_cells",
    "blind_order": """
        SELECT id, pos, CASE WHEN pos < 26 THEN '' ELSE chr((64 + pos // 26)::INT) END || chr((65 + pos % 26)::INT) AS letter, filename, label
        FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY md5('7:' || CAST(id AS VARCHAR) || ':' || filename), filename, label) - 1)::INT AS pos
              FROM grid_cells) drawn""",
    "grid_outcome": "SELECT * FROM grid_results",
    "grid_summary": """
        SELECT provider, count(*) AS clips, count(*) FILTER (WHERE NOT ok) AS failed, bool_and(has_key) AS has_key FROM grid_results GROUP BY provider""",
    "delete_tests": "SELECT id FROM ab_tests WHERE published",
    "delete_tests_options": "SELECT o.id, ab_test_id FROM ab_options o JOIN ab_tests t ON t.id = ab_test_id WHERE published",
    "delete_tests_votes": "SELECT id, ab_test_id FROM ab_votes WHERE ab_test_id NOT IN (SELECT id FROM ab_tests WHERE NOT published)",
    "delete_tests_keys": "SELECT audio_key FROM ab_options JOIN ab_tests t ON t.id = ab_test_id WHERE NOT published AND audio_key IS NOT NULL",
    "create_tests": """
        SELECT p_partkey * 2 + k AS id, p_partkey AS ab_test_id, CASE k WHEN 0 THEN 'A' ELSE 'B' END AS key,
               CASE k WHEN 0 THEN 'one ' ELSE 'two ' END || p_brand AS label, 'ab_tests/' || CAST(p_partkey * 2 + k AS VARCHAR) || '.mp3' AS audio_key,
               k AS opt_order FROM part, (SELECT unnest([0, 1]) AS k) two""",
    "create_tests_rows": "SELECT p_partkey AS id, p_name AS title, true AS published FROM part",
    # streams
    "stream_event_ingest": """
        SELECT event_id AS id, event_type AS task, least(4000, length(props) * (1 + event_id % 600)) AS message_chars, true AS no_trace FROM events""",
    "stream_heartbeats": """
        SELECT 'host-' || CAST(user_id % 40 AS VARCHAR) AS host, max(ts) AS seen_at, max((ts, value))[2] AS value FROM events GROUP BY 1""",
    "stream_liveness": "SELECT * FROM alive WHERE alive_until <= (SELECT max(seen_at) FROM beats) - INTERVAL 120 SECOND",
    "stream_expiry": """
        SELECT host, status, "at" FROM (
          SELECT host, 'online' AS status, alive_from AS "at" FROM alive UNION ALL SELECT host, 'offline', alive_until FROM alive) edges
        WHERE "at" <= (SELECT max(seen_at) FROM beats) - INTERVAL 120 SECOND""",
    "stream_status_counts": """
        SELECT status, count(*) AS n FROM (
          SELECT user_id, arg_max(event_type, (epoch_us(ts) * 8 + event_id % 8, event_type)) AS status FROM events GROUP BY user_id) s
        GROUP BY status""",
    "stream_segment_ingest": """
        SELECT user_id AS book_id, event_id AS seg_order, event_type AS status FROM events
        QUALIFY (user_id % 5 = 0 AND event_id % 2 = 1) = bool_or(user_id % 5 = 0 AND event_id % 2 = 1) OVER (PARTITION BY user_id)""",
    "stream_vote_upsert": """
        SELECT event_id % 117 AS ab_test_id, user_id % 20 AS user_id,
               arg_max(CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'no_diff' END, (ts, event_id)) AS choice,
               min(ts) AS created_at, max(ts) AS voted_at FROM events GROUP BY 1, 2""",
    "stream_progress_upsert": """
        SELECT user_id, book_id, CAST(event_id % 9 AS INT) AS seg_idx, value AS t, ts AS updated
        FROM (SELECT *, event_id * 7 % 50 AS book_id FROM events) e
        QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 41 <> 0""",
    "stream_capped_log": """
        SELECT event_id AS id, event_type AS source, ts AS seen_at FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000""",
}
ORACLES["stream_status_poll"] = ORACLES["status_summary"]
# The same chain with the page texts in place of the raw books.
_FROM_SPANS = {**EXTRA, "bt_banner": f"SELECT doc_id, page_count, {_banners('text')} AS text FROM doc_texts"}


# Column types of the Spark results where DuckDB's own arithmetic yields a wider one.
_REPORT = dict.fromkeys(("segments", "chapters", "min", "max", "flagged"), "INT") | dict.fromkeys(
    ("total", "mean", "per_page"), "BIGINT"
)
_LINE, _POS = {"line_no": "INT"}, {"pos": "INT"}
_TYPES: dict[str, dict[str, str]] = {
    "copy_table": {"chars": "BIGINT"}, "write_segments": {"chars": "INT"}, "write_report": _REPORT,
    "extract_report": _REPORT, "doc_text": {"page_count": "INT"}, "is_prose_line": _LINE, "smart_titlecase": _LINE,
    "chapter_number": _LINE, "heading_candidates": _LINE, "body_gap": {"gap": "INT", **_LINE}, "filter_by_gap": _LINE,
    "dedup_headings": _LINE, "longest_increasing_run": _LINE, "clean_title": _LINE,
    "segment_chapters": {"region_no": "INT"}, "split_sentences": _POS, "split_oversized": _POS, "pack_chunks": _POS, "pack_rows": _POS,
    "review_summary": {"chars": "BIGINT"}, "parse_metadata": {"year": "INT"}, "render_grid": {"take": "INT"},
    "stream_event_ingest": {"message_chars": "INT"}, "failure_fallback": {"traceback": "INT"},
    "record_events": {"message_chars": "INT", "traceback_chars": "INT"},
    **dict.fromkeys(("emit_chunks", "prepare_corpus", "prepare_from_spans", "polish_guard", "polish_guard_table", "apply_polish", "polish_calls"), {"seg_order": "INT"}),
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f'CAST("{col}" AS {kind}) AS "{col}"' for col, kind in _TYPES.get(name, {}).items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) typed" if casts else sql


def oracle_sql() -> dict[str, str]:
    out = {name: duckdb_sql(_typed(name, sql), EXTRA) for name, sql in ORACLES.items()}
    name, sql = "prepare_from_spans", "SELECT doc_id, seg_order, chapter_title, text FROM chunk_rows"
    out[name] = duckdb_sql(_typed(name, sql), _FROM_SPANS)
    return out
