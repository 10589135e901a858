"""DuckDB SQL twins of the registered queries.

Each query is written independently of the Spark code, over the raw views
(`events`, `pages`, ...), with the fixture rules of `quire.sources.fixtures`
restated as CTEs.  Column names and types match the Spark output.
"""

from __future__ import annotations

NL = "chr(10)"

# --- fixture CTEs ---------------------------------------------------------------

LEDGER_BASE = """
ledger_base AS (
  SELECT event_id, ts, user_id, event_type, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""

_RAW_DATA = """CASE
    WHEN k % 25 = 13 THEN 'not valid json'
    WHEN k % 25 = 7 THEN printf('{"analysis":{"summary":"%s note %d","tags":"k%d","relevanceScore":"%d"}}',
                                event_type, event_id, k, 1 + k % 10)
    ELSE printf('{"analysis":{"summary":"%s note %d","tags":["k%d","g%d"],"relevanceScore":%d}}',
                event_type, event_id, k, k % 7, 1 + k % 10)
  END"""

_LEDGER_COLS = f"""
    CAST(ts AS TIMESTAMP) AS processed_at,
    event_type AS category,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'page-' || CAST(event_id AS VARCHAR) END AS page_id,
    {_RAW_DATA} AS raw_data,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'completed' END AS status,
    event_id AS version"""

LEDGER_ROWS = LEDGER_BASE + f""",
ledger_rows AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id, {_LEDGER_COLS}
  FROM ledger_base
)"""

LEDGER_VERSIONS = LEDGER_BASE + f""",
ledger_versions AS (
  SELECT CAST(user_id AS VARCHAR) AS post_id, {_LEDGER_COLS}
  FROM ledger_base
)"""

LEDGER_CURRENT = LEDGER_VERSIONS + """,
ledger_current AS (
  SELECT * FROM ledger_versions
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY version DESC) = 1
)"""

ANALYSIS_COLS = """
    CASE WHEN json_valid(raw_data) AND json_type(raw_data, '$.analysis.tags') = 'ARRAY'
         THEN json_extract_string(raw_data, '$.analysis.tags[*]') END AS tags,
    CASE WHEN json_valid(raw_data)
         THEN TRY_CAST(json_extract_string(raw_data, '$.analysis.relevanceScore') AS DOUBLE) END AS score,
    CASE WHEN json_valid(raw_data)
         THEN json_extract_string(raw_data, '$.analysis.summary') END AS summary"""

WEEK = LEDGER_ROWS + f""",
week AS (
  SELECT post_id, processed_at, category, {ANALYSIS_COLS}
  FROM ledger_rows
  WHERE processed_at >= (SELECT max(processed_at) FROM ledger_rows) - INTERVAL 7 DAY
)"""

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def iso(col: str) -> str:
    return ISO.format(col)


# --- step 1: statistics -----------------------------------------------------------

WEEKLY_BY_CATEGORY = f"""
WITH {WEEK}
SELECT category, count(*) AS n FROM week GROUP BY category
"""

_TOP_TAGS = """
tag_rows AS (
  SELECT post_id, processed_at, t.tag, t.pos
  FROM week, unnest(week.tags) WITH ORDINALITY AS t(tag, pos)
  WHERE week.tags IS NOT NULL
),
tag_first AS (
  SELECT tag, count(*) OVER (PARTITION BY tag) AS n, processed_at, post_id, pos
  FROM tag_rows
  QUALIFY row_number() OVER (PARTITION BY tag ORDER BY processed_at DESC, post_id DESC, pos ASC) = 1
),
top_tags AS (
  SELECT row_number() OVER (ORDER BY n DESC, processed_at DESC, post_id DESC, pos ASC, tag) AS rank, tag, n
  FROM tag_first
  ORDER BY rank LIMIT 10
)"""

WEEKLY_TOP_TAGS = f"""
WITH {WEEK},{_TOP_TAGS}
SELECT CAST(rank AS BIGINT) AS rank, tag, n FROM top_tags
"""

_HIGHLIGHTS = f"""
highlights AS (
  SELECT row_number() OVER (ORDER BY processed_at DESC, post_id DESC) AS rank,
         post_id, coalesce(summary, '') AS summary, category, {iso('processed_at')} AS processed_at
  FROM week WHERE score >= 8
  ORDER BY rank LIMIT 10
)"""

WEEKLY_HIGHLIGHTS = f"""
WITH {WEEK},{_HIGHLIGHTS}
SELECT CAST(rank AS BIGINT) AS rank, post_id, summary, category, processed_at FROM highlights
"""

WEEKLY_REPORT = f"""
WITH {WEEK},{_TOP_TAGS},{_HIGHLIGHTS},
cats AS (SELECT category, count(*) AS n FROM week GROUP BY category)
SELECT
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM cats) AS total_processed,
  (SELECT coalesce('{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}', '{{}}') FROM cats) AS by_category,
  (SELECT coalesce('[' || string_agg('{{"tag":"' || tag || '","count":' || n || '}}', ',' ORDER BY rank) || ']', '[]') FROM top_tags) AS top_tags,
  (SELECT coalesce('[' || string_agg('{{"tweetId":"' || post_id || '","summary":"' || summary || '","category":"' || category || '"}}', ',' ORDER BY rank) || ']', '[]') FROM highlights) AS highlights
"""

LEDGER_STATS = f"""
WITH {LEDGER_ROWS},
cats AS (SELECT category, count(*) AS n FROM ledger_rows GROUP BY category)
SELECT CAST(sum(n) AS BIGINT) AS total,
       '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS by_category
FROM cats
"""

LEDGER_HEALTH = f"""
WITH {LEDGER_ROWS}
SELECT count(*) AS total,
       count(*) FILTER (WHERE coalesce(status, 'completed') = 'completed') AS n_completed,
       count(*) FILTER (WHERE status = 'processing') AS n_processing,
       count(*) FILTER (WHERE status = 'failed') AS n_failed,
       {iso('max(processed_at)')} AS latest_processed_at
FROM ledger_rows
"""

# --- step 2: ledger ---------------------------------------------------------------

from quire.functions import fixed
from quire.functions.markdown import ENTITIES  # noqa: E402

URL_RE = fixed.URL_PATTERN

POSTS_PAGES = f"""
page_docs AS (
  SELECT p.page_id, p.url AS page_url, d.doc_id, d.text AS doc_text, d.lang, d.source
  FROM pages p JOIN documents d ON p.page_id = d.doc_id
),
posts_pages AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         doc_text || ' ' || page_url
           || CASE WHEN lang = 'de' THEN ' https://www.youtube.com/watch?v=' || left(md5(page_url), 11) ELSE '' END AS text,
         source AS author_username, upper(source) AS author_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id) AS created_at,
         page_id, page_url, lang
  FROM page_docs
),
posts AS (
  SELECT *,
         regexp_extract_all(text, '{URL_RE}')
           || CASE WHEN page_id % 3 = 2 THEN ['https://video.example.com/' || CAST(page_id AS VARCHAR) || '.mp4']
                   ELSE []::VARCHAR[] END AS urls,
         CASE WHEN page_id % 3 IN (1, 2) THEN ['https://pbs.example.com/media/' || CAST(page_id AS VARCHAR) || '.jpg']
              ELSE []::VARCHAR[] END AS images,
         false AS is_thread
  FROM posts_pages
)"""

_LEDGER_OUT = f"post_id, version, {iso('processed_at')} AS processed_at, category, status, page_id"

LEDGER_CURRENT_Q = f"""
WITH {LEDGER_CURRENT}
SELECT {_LEDGER_OUT} FROM ledger_current
"""

LEDGER_RELEASE = f"""
WITH {LEDGER_CURRENT}
SELECT post_id, version, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status
FROM ledger_current
"""

_BLOCKED = """
blocked AS (
  SELECT post_id FROM ledger_current WHERE coalesce(status, 'completed') IN ('completed', 'processing')
)"""

NEW_POSTS = f"""
WITH {LEDGER_CURRENT},{_BLOCKED},{POSTS_PAGES}
SELECT id, author_username FROM posts_pages p
WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.post_id = p.id)
"""

CLAIMABLE_POSTS = f"""
WITH {LEDGER_CURRENT},{_BLOCKED},{POSTS_PAGES}
SELECT id AS post_id, CAST(1099511627776 AS BIGINT) AS version,
       {iso('(SELECT max(processed_at) FROM ledger_versions)')} AS processed_at,
       'review' AS category, 'processing' AS status, CAST(NULL AS VARCHAR) AS page_id, '{{}}' AS raw_data
FROM posts_pages p
WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.post_id = p.id)
"""

PROCESSED_POSTS = f"""
WITH {LEDGER_CURRENT},{POSTS_PAGES}
SELECT id FROM posts_pages
WHERE id IN (SELECT post_id FROM ledger_current WHERE coalesce(status, 'completed') = 'completed')
"""

LOCKED_POSTS = f"""
WITH {LEDGER_CURRENT}
SELECT post_id FROM ledger_current WHERE status = 'processing'
"""

# --- step 3: ingest ---------------------------------------------------------------

_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _opt(doc: str, path: str, ok: str) -> str:
    return f"(json_type({doc}, '{path}') IS NULL OR json_type({doc}, '{path}') IN {ok})"


_MEDIA_OK = (
    "json_type(m) = 'OBJECT' AND json_type(m, '$.type') = 'VARCHAR' "
    "AND json_extract_string(m, '$.type') IN ('photo', 'video', 'animated_gif') "
    "AND json_type(m, '$.url') = 'VARCHAR' AND "
    + " AND ".join(
        [
            _opt("m", "$.previewUrl", "('VARCHAR')"),
            _opt("m", "$.width", _NUM),
            _opt("m", "$.height", _NUM),
            _opt("m", "$.videoUrl", "('VARCHAR')"),
            _opt("m", "$.durationMs", _NUM),
        ]
    )
)

REASON = f"""CASE
    WHEN NOT json_valid(raw) THEN 'malformed_json'
    WHEN json_type(raw) <> 'OBJECT' THEN 'not_object'
    WHEN coalesce(json_type(raw, '$.id'), '') <> 'VARCHAR' THEN 'id'
    WHEN coalesce(json_type(raw, '$.text'), '') <> 'VARCHAR' THEN 'text'
    WHEN coalesce(json_type(raw, '$.createdAt'), '') <> 'VARCHAR' THEN 'createdAt'
    WHEN coalesce(json_type(raw, '$.author'), '') <> 'OBJECT'
      OR coalesce(json_type(raw, '$.author.username'), '') <> 'VARCHAR'
      OR coalesce(json_type(raw, '$.author.name'), '') <> 'VARCHAR' THEN 'author'
    WHEN NOT ({_opt('raw', '$.replyCount', _NUM)} AND {_opt('raw', '$.retweetCount', _NUM)}
              AND {_opt('raw', '$.likeCount', _NUM)}) THEN 'counts'
    WHEN NOT ({_opt('raw', '$.conversationId', "('VARCHAR')")} AND {_opt('raw', '$.inReplyToStatusId', "('VARCHAR')")}
              AND {_opt('raw', '$.authorId', "('VARCHAR')")}) THEN 'ids'
    WHEN json_type(raw, '$.media') IS NOT NULL
      AND (json_type(raw, '$.media') <> 'ARRAY'
           OR coalesce(list_bool_or(list_transform(json_extract(raw, '$.media[*]'), lambda m: NOT ({_MEDIA_OK}))), false))
      THEN 'media'
  END"""

_CREATED = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id)"

RAW_POSTS_PAGES = f"""
raw_page_docs AS (
  SELECT p.page_id, p.url AS page_url, d.doc_id, d.text AS doc_text, d.lang, d.source
  FROM pages p JOIN documents d ON p.page_id = d.doc_id
),
raw_parts AS (
  SELECT page_id,
         CAST(doc_id AS VARCHAR) AS id,
         doc_text || ' ' || page_url
           || CASE WHEN lang = 'de' THEN ' https://www.youtube.com/watch?v=' || left(md5(page_url), 11) ELSE '' END AS text,
         CASE WHEN page_id % 2 = 0 THEN strftime({_CREATED}, '%Y-%m-%dT%H:%M:%S.%gZ')
              ELSE strftime({_CREATED}, '%a %b %d %H:%M:%S +0000 %Y') END AS created,
         json_object('username', source, 'name', upper(source)) AS author,
         CASE page_id % 3
           WHEN 1 THEN json_array(json_object('type', 'photo',
                         'url', 'https://pbs.example.com/media/' || CAST(page_id AS VARCHAR) || '.jpg'))
           WHEN 2 THEN json_array(json_object('type', 'video',
                         'url', 'https://pbs.example.com/media/' || CAST(page_id AS VARCHAR) || '.jpg',
                         'videoUrl', 'https://video.example.com/' || CAST(page_id AS VARCHAR) || '.mp4',
                         'durationMs', page_id * 1000))
         END AS media
  FROM raw_page_docs
),
raw_good AS (
  SELECT *,
    CASE WHEN media IS NULL
         THEN json_object('id', id, 'text', text, 'createdAt', created, 'author', author, 'conversationId', id)
         ELSE json_object('id', id, 'text', text, 'createdAt', created, 'author', author, 'conversationId', id, 'media', media)
    END::VARCHAR AS good
  FROM raw_parts
),
raw_posts AS (
  SELECT page_id, id, text, CASE
    WHEN page_id % 50 = 29 THEN left(good, 20)
    WHEN page_id % 20 = 11 THEN json_object('id', id, 'text', text, 'createdAt', created, 'author', author,
        'conversationId', id, 'media', json_array(json_object('type', 'sticker', 'url', 'https://pbs.example.com/media/s.webp')))::VARCHAR
    WHEN page_id % 10 = 3 THEN json_object('id', page_id, 'text', text, 'createdAt', created, 'author', author,
        'conversationId', id)::VARCHAR
    WHEN page_id % 10 = 7 THEN json_object('id', id, 'text', text, 'createdAt', created, 'conversationId', id)::VARCHAR
    ELSE good END AS raw
  FROM raw_good
),
checked AS (SELECT *, {REASON} AS reason FROM raw_posts)"""

INGEST_VALID = f"""
WITH {RAW_POSTS_PAGES},{POSTS_PAGES}
SELECT p.id, p.author_username, p.author_name, {iso('p.created_at')} AS created_at,
       CAST(len(p.urls) AS BIGINT) AS n_urls, array_to_string(p.urls, ' ') AS urls,
       array_to_string(p.images, ' ') AS images, p.is_thread
FROM posts p JOIN checked c ON c.page_id = p.page_id
WHERE c.reason IS NULL
"""

INGEST_QUARANTINE = f"""
WITH {RAW_POSTS_PAGES}
SELECT page_id, reason FROM checked WHERE reason IS NOT NULL
"""

POST_LOOKUP = f"""
WITH {POSTS_PAGES}
SELECT id, author_username FROM posts_pages
WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
"""

POST_URLS = f"""
WITH {POSTS_PAGES}
SELECT id, CAST(u.pos - 1 AS BIGINT) AS pos, u.url
FROM posts, unnest(posts.urls) WITH ORDINALITY AS u(url, pos)
"""

POST_MENTIONS = rf"""
WITH {POSTS_PAGES}
SELECT id, CAST(h.pos - 1 AS BIGINT) AS pos, h.handle
FROM posts_pages, unnest(regexp_extract_all(text, '@(\w+)', 1)) WITH ORDINALITY AS h(handle, pos)
"""

_MEDIA_EXPECTED = """
media_expected AS (
  SELECT CAST(page_id AS VARCHAR) AS post_id, CAST(0 AS BIGINT) AS pos,
         CASE page_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'animated_gif' END AS type,
         'https://pbs.example.com/media/' || CAST(page_id AS VARCHAR) || '.jpg' AS url,
         CASE WHEN page_id % 5 <> 0 THEN 'https://pbs.example.com/media/' || CAST(page_id AS VARCHAR) || '.jpg:small' END AS preview_url,
         CASE WHEN page_id % 2 = 0 THEN 1000 + page_id % 100 ELSE 600 + page_id % 50 END AS width,
         CAST(trunc((CASE WHEN page_id % 2 = 0 THEN 1000 + page_id % 100 ELSE 600 + page_id % 50 END) / 2) AS BIGINT) AS height,
         CASE WHEN page_id % 3 <> 0 THEN 'https://video.example.com/' || CAST(page_id AS VARCHAR) ||
           CASE WHEN (page_id % 4) * 1000 >= (page_id % 3) * 1000 + 1000 AND (page_id % 4) * 1000 >= 2000 THEN '/a.mp4'
                WHEN (page_id % 3) * 1000 + 1000 >= 2000 THEN '/b.mp4'
                ELSE '/c.mp4' END END AS video_url,
         CAST(CASE WHEN page_id % 3 <> 0 AND page_id <> 0 THEN page_id * 1000 END AS DOUBLE) AS duration_ms
  FROM pages
  WHERE page_id % 11 <> 5
)"""

POST_MEDIA = f"""
WITH {_MEDIA_EXPECTED}
SELECT * FROM media_expected
"""

BEST_VARIANT = f"""
WITH {_MEDIA_EXPECTED}
SELECT post_id, video_url FROM media_expected WHERE video_url IS NOT NULL
"""

NEWEST_POSTS = f"""
WITH {POSTS_PAGES}
SELECT id, {iso('created_at')} AS created_at FROM posts_pages
ORDER BY created_at DESC, id DESC LIMIT 20
"""

# --- step 4: URL and text columns ---------------------------------------------------

JS = fixed.JS_SPACE


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{JS}]+|[{JS}]+$', '', 'g')"


def _skip_any(u: str) -> str:
    return " OR ".join(f"regexp_matches({u}, '{p}')" for p in fixed.SKIP_PATTERNS)


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_VALID = "regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_VID = fixed.VIDEO_ID_PATTERN

URL_CLASSES = rf"""
WITH {POSTS_PAGES},
u AS (
  SELECT id, CAST(o.pos - 1 AS BIGINT) AS pos, o.url
  FROM posts, unnest(posts.urls) WITH ORDINALITY AS o(url, pos)
),
c AS (
  SELECT *, {_HOST} AS host, {_VALID} AS valid,
         list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1] AS seg
  FROM u
)
SELECT id, pos, url, CASE WHEN valid THEN host END AS host,
       coalesce(valid AND NOT ({_skip_any('url')}), false) AS is_scrapable,
       coalesce(valid AND NOT (host IN ('youtube.com', 'youtu.be', 'twitter.com', 'x.com')
                               OR suffix(host, '.youtube.com') OR suffix(host, '.youtu.be')
                               OR suffix(host, '.twitter.com') OR suffix(host, '.x.com')
                               OR regexp_matches(url, '{fixed.SKIP_PATTERNS[4]}')
                               OR regexp_matches(url, '{fixed.SKIP_PATTERNS[5]}')), false) AS is_scrapable_strict,
       regexp_matches(url, '{_VID}') AS is_video,
       nullif(regexp_extract(url, '{_VID}', 1), '') AS video_id,
       CASE WHEN valid THEN coalesce(nullif(regexp_replace(regexp_replace(coalesce(seg, ''), '[-_]', ' ', 'g'), '\.\w+$', ''), ''), nullif(host, ''))
            ELSE url END AS url_title,
       CASE WHEN valid THEN nullif(host, '') END AS site_name
FROM c
"""

VIDEO_IDS = rf"""
WITH {POSTS_PAGES}
SELECT id, video_id FROM (
  SELECT id, nullif(regexp_extract(url, '{_VID}', 1), '') AS video_id
  FROM posts, unnest(posts.urls) AS o(url)
) WHERE video_id IS NOT NULL
"""


def _trunc(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({x}, {n - 3}) || '...' END"


def _cut(x: str, n: int) -> str:
    return f"left({x}, {n}) || CASE WHEN length({x}) > {n} THEN chr(10) || chr(10) || '[...truncated]' ELSE '' END"


TRUNCATE_TEXT = f"""
SELECT doc_id, {_trunc('text', 50)} AS t50, {_trunc('text', 280)} AS t280, {_trunc('text', 2000)} AS t2000,
       {_cut('text', 8000)} AS cut8000, {_cut('text', 6000)} AS cut6000
FROM documents
"""

_TRANSCRIPTS = rf"""
vtt_docs AS (
  SELECT left(md5(p.url), 11) AS video_id,
         'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || 'Language: ' || d.lang || chr(10) || chr(10)
         || array_to_string(list_transform(string_split(d.text, chr(10)), lambda l, i:
              CAST(i AS VARCHAR) || chr(10) || '00:00:01.000 --> 00:00:02.000' || chr(10) || '<v S>' || l || '</v>'
              || chr(10) || l), chr(10) || chr(10)) AS vtt
  FROM pages p JOIN documents d ON p.page_id = d.doc_id
),
vtt_lines AS (
  SELECT video_id,
    list_filter(
      list_transform(
        list_filter(string_split(vtt, chr(10)), lambda l:
          NOT (starts_with(l, 'WEBVTT') OR starts_with(l, 'Kind:') OR starts_with(l, 'Language:'))
          AND NOT regexp_matches(l, '^\d{{2}}:\d{{2}}')
          AND NOT regexp_matches(l, '^[\d:.,{JS}-]+$')
          AND {js_trim('l')} <> ''),
        lambda l: {js_trim("regexp_replace(l, '<[^>]+>', '', 'g')")}),
      lambda l: l <> '') AS lines
  FROM vtt_docs
),
cleaned AS (
  SELECT video_id,
    {js_trim(f"regexp_replace(array_to_string(list_filter(lines, lambda l, i: i = 1 OR l <> lines[i - 1]), ' '), '[{JS}]+', ' ', 'g')")} AS transcript
  FROM vtt_lines
)"""

TRANSCRIPT_CLEAN = f"""
WITH {_TRANSCRIPTS}
SELECT video_id, transcript FROM cleaned
"""

HTML_ESCAPE = """
SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped
FROM documents
"""

def utf16_len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def chunk_fold(text: str, limit: int) -> str:
    """Greedy line packing as a list fold (same rule as the Spark side)."""
    ln = utf16_len("line")
    return f"""(SELECT CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END FROM (
      SELECT list_reduce(string_split({text}, chr(10)),
        lambda acc, line: CASE WHEN acc.n + {ln} + 1 > {limit}
          THEN {{'done': list_append(acc.done, acc.cur), 'cur': line, 'n': CAST({ln} AS BIGINT)}}
          ELSE {{'done': acc.done, 'cur': acc.cur || CASE WHEN acc.cur <> '' THEN chr(10) ELSE '' END || line,
                'n': acc.n + CASE WHEN acc.cur <> '' THEN 1 ELSE 0 END + CAST({ln} AS BIGINT)}} END,
        {{'done': []::VARCHAR[], 'cur': '', 'n': CAST(0 AS BIGINT)}}) AS r))"""


MESSAGE_CHUNKS = f"""
WITH chunks AS (SELECT doc_id, {chunk_fold('text', fixed.DIGEST_CHUNK)} AS pieces FROM documents)
SELECT doc_id, CAST(c.pos - 1 AS BIGINT) AS chunk_no, CAST({utf16_len('c.chunk')} AS BIGINT) AS chunk_len
FROM chunks, unnest(chunks.pieces) WITH ORDINALITY AS c(chunk, pos)
"""

# --- step 5: enrichment ------------------------------------------------------------------

from quire.operators.inference import (  # noqa: E402
    DEFAULT_TASK,
    DEFAULT_TRIAGE_HEAD,
    DEFAULT_TRIAGE_TAIL,
    DEFAULT_USER_CONTEXT,
)


def valid_url(u: str) -> str:
    return f"regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"


def host_of(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def scrapable(u: str) -> str:
    skip = " OR ".join(f"regexp_matches({u}, '{p}')" for p in fixed.SKIP_PATTERNS)
    return f"coalesce({valid_url(u)} AND NOT ({skip}), false)"


def url_title(u: str) -> str:
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    seg = f"list_filter(string_split({path}, '/'), lambda s: s <> '')[-1]"
    return (
        f"CASE WHEN {valid_url(u)} THEN coalesce(nullif(regexp_replace(regexp_replace(coalesce({seg}, ''), "
        f"'[-_]', ' ', 'g'), '\\.\\w+$', ''), ''), nullif({host_of(u)}, '')) ELSE {u} END"
    )


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '[{JS}]+', ' ', 'g')"


def trunc(x: str, n: int) -> str:
    return _trunc(x, n)


_ARTICLES = f"""
parsed_pages AS (
  SELECT url, html,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'),
      '(?s)<nav[^>]*>.*?</nav>', ' ', 'g') AS cleaned
  FROM pages
),
articles AS (
  SELECT url,
    coalesce(nullif({js_trim("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")}, ''), {url_title('url')}) AS title,
    {js_trim(squeeze("regexp_replace(CASE WHEN regexp_extract(cleaned, '(?s)<article[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(cleaned, '(?s)<article[^>]*>(.*?)</article>', 1) ELSE regexp_extract(cleaned, '(?s)<body[^>]*>(.*)</body>', 1) END, '<[^>]+>', ' ', 'g')"))} AS content,
    CASE WHEN {valid_url('url')} THEN nullif({host_of('url')}, '') END AS site_name
  FROM parsed_pages
)"""

# The stored pages hold headings, paragraphs, line breaks and bold text inside `<article>`.
_ENTITIES_SQL = "x"
for _name, _char in ENTITIES.items():
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"

ARTICLE_MARKDOWN = f"""
WITH {_ARTICLES},
marked AS (
  SELECT url, title,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1),
      '[ \\t\\r\\n\\f]+', ' ', 'g'), '<h1>', chr(1) || '# ', 'g'), '</h1>|</?p>', chr(1), 'g'),
      ' ?<br> ?', chr(10), 'g') AS m
  FROM parsed_pages JOIN articles USING (url)
),
blocks AS (
  SELECT url, title, list_transform(string_split(m, chr(1)), lambda b:
    trim(regexp_replace(replace(b, '<b>', '**'), chr(10), '  ' || chr(10), 'g'), ' ' || chr(10))
    || CASE WHEN contains(b, '<b>') THEN '**' ELSE '' END) AS bs
  FROM marked
)
SELECT url, title, array_to_string(list_transform(list_filter(bs, lambda x: x <> ''),
  lambda x: {_ENTITIES_SQL}), chr(10) || chr(10)) AS content
FROM blocks
"""

ARTICLE_PARSE = f"""
WITH {_ARTICLES}
SELECT url, title, CAST(length(content) AS BIGINT) AS content_len, sha256(content) AS content_sha,
       CAST(NULL AS VARCHAR) AS excerpt, site_name
FROM articles
"""

_TRIAGE = f"""
tri0 AS (
  SELECT p.*, l.toxic, l.quality,
         list_filter(p.urls, lambda u: {scrapable('u')}) AS want_articles,
         list_filter(p.urls, lambda u: nullif(regexp_extract(u, '{_VID}', 1), '') IS NOT NULL) AS want_videos,
         {js_trim('p.text')} = '' AS blank
  FROM posts p LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.id
),
tri AS (
  SELECT *,
    CASE WHEN is_thread THEN 'thread' WHEN len(want_videos) > 0 THEN 'video_share'
         WHEN len(want_articles) > 0 THEN 'article_share' WHEN len(images) > 0 THEN 'image_post'
         ELSE 'tweet' END AS content_type,
    CASE WHEN blank OR coalesce(toxic = 1, false) THEN 'skip'
         WHEN len(want_articles) > 0 OR len(want_videos) > 0 THEN 'high' ELSE 'medium' END AS estimated_value,
    CASE WHEN blank THEN 'blank text' WHEN coalesce(toxic = 1, false) THEN 'flagged toxic' END AS skip_reason
  FROM tri0
),
live AS (SELECT * FROM tri WHERE estimated_value <> 'skip')"""

_CONTEXT = f"""
ctx_articles AS (
  SELECT w.id AS post_id, CAST(w.pos - 1 AS BIGINT) AS pos, w.url, a.title,
         a.content, CAST(length(a.content) AS BIGINT) AS content_len
  FROM (SELECT id, o.url, o.pos FROM live, unnest(live.want_articles) WITH ORDINALITY AS o(url, pos)) w
  JOIN articles a ON a.url = w.url
  WHERE nullif(a.content, '') IS NOT NULL
),
ctx_transcripts AS (
  SELECT w.id AS post_id, CAST(w.pos - 1 AS BIGINT) AS pos, w.url, w.video_id, c.transcript
  FROM (SELECT id, o.url, o.pos, nullif(regexp_extract(o.url, '{_VID}', 1), '') AS video_id
        FROM live, unnest(live.want_videos) WITH ORDINALITY AS o(url, pos)) w
  JOIN cleaned c ON c.video_id = w.video_id
  WHERE nullif(c.transcript, '') IS NOT NULL
),
image_texts AS (
  SELECT url,
    printf('%s of %dx%d pixels', type, width, height)
    || CASE WHEN type = 'photo' THEN chr(10) || '📝 Text: ' || {host_of('url')} ELSE '' END
    || chr(10) || '🔑 Key elements: ' || type || ', w' || CAST(width AS VARCHAR) AS description
  FROM media_expected
),
ctx_images AS (
  SELECT w.id AS post_id, CAST(w.pos - 1 AS BIGINT) AS pos, w.url, t.description
  FROM (SELECT id, o.url, o.pos FROM live, unnest(live.images) WITH ORDINALITY AS o(url, pos)) w
  JOIN image_texts t ON t.url = w.url
  WHERE nullif(t.description, '') IS NOT NULL
)"""

_CTX_ALL = f"{POSTS_PAGES},{_TRIAGE},{_ARTICLES},{_TRANSCRIPTS},{_MEDIA_EXPECTED},{_CONTEXT}"

ENRICHED_ARTICLES = f"""
WITH {_CTX_ALL}
SELECT post_id, pos, url, title, content, content_len FROM ctx_articles
"""

ENRICHED_TRANSCRIPTS = f"""
WITH {_CTX_ALL}
SELECT post_id, pos, url, video_id, transcript FROM ctx_transcripts
"""

ENRICHED_IMAGES = f"""
WITH {_CTX_ALL}
SELECT post_id, pos, url, description FROM ctx_images
"""

IMAGE_DESCRIPTIONS = f"""
WITH {_CTX_ALL}
SELECT url, description FROM image_texts
"""

THREAD_EXPAND = """
WITH conv AS (
  SELECT conv_id, turn, role, text,
         CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS member_id
  FROM conversations
),
bad AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
bm AS (
  SELECT c.conv_id, c.member_id FROM conv c JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn
  WHERE c.role <> 'system' AND c.turn > 0
)
SELECT bm.member_id AS post_id, m.member_id, m.turn, m.text
FROM bm JOIN conv m ON m.conv_id = bm.conv_id
WHERE m.conv_id NOT IN (SELECT conv_id FROM bad) AND m.member_id <> bm.member_id
"""

VIDEO_INFO = rf"""
WITH v AS (
  SELECT left(md5(CAST(doc_id AS VARCHAR)), 11) AS video_id,
         string_split({js_trim("concat_ws('|||', text, lang, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN ' ' || CAST(n_chars AS VARCHAR) || 's' WHEN 2 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) || '.5' END) || chr(10)")}, '|||') AS parts
  FROM documents
)
SELECT video_id, coalesce(parts[1], '') AS title, coalesce(parts[2], '') AS description,
       CAST(coalesce(TRY_CAST(regexp_extract({js_trim("coalesce(parts[3], '')")}, '^([+-]?\d+)', 1) AS BIGINT), 0) AS BIGINT) AS duration
FROM v
"""

# --- step 6: inference ---------------------------------------------------------------------

TRIAGE_RULES = f"""
WITH {POSTS_PAGES},{_TRIAGE}
SELECT id AS post_id, content_type, estimated_value,
       CAST(len(want_articles) AS BIGINT) AS n_articles, CAST(len(want_videos) AS BIGINT) AS n_transcripts,
       CAST(len(images) AS BIGINT) AS n_images, is_thread AS needs_thread, skip_reason
FROM tri
"""

TRIAGE_SKIP = f"""
WITH {POSTS_PAGES},{_TRIAGE}
SELECT id AS post_id, 'review' AS category, 'completed' AS status, CAST(NULL AS VARCHAR) AS page_id, skip_reason
FROM tri WHERE estimated_value = 'skip'
"""

_ANALYSIS = f"""
words AS (
  SELECT id, w.word, count(*) AS n
  FROM posts, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{5,}}')) AS w(word)
  GROUP BY id, w.word
),
tags AS (
  SELECT id, list(word ORDER BY rk) AS tags FROM (
    SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rk FROM words
  ) WHERE rk <= 9 GROUP BY id
),
counts AS (
  SELECT l.id,
    (SELECT count(*) FROM ctx_articles a WHERE a.post_id = l.id) AS n_articles,
    (SELECT count(*) FROM ctx_transcripts t WHERE t.post_id = l.id) AS n_transcripts,
    (SELECT count(*) FROM ctx_images i WHERE i.post_id = l.id) AS n_images,
    (SELECT a.title FROM ctx_articles a WHERE a.post_id = l.id ORDER BY a.pos LIMIT 1) AS first_title,
    (SELECT a.content FROM ctx_articles a WHERE a.post_id = l.id ORDER BY a.pos LIMIT 1) AS first_article,
    (SELECT t.transcript FROM ctx_transcripts t WHERE t.post_id = l.id ORDER BY t.pos LIMIT 1) AS first_transcript
  FROM live l
),
an0 AS (
  SELECT l.*, c.n_articles, c.n_transcripts, c.n_images, c.first_title, c.first_article, c.first_transcript,
    coalesce(t.tags, []::VARCHAR[]) AS tags,
    {js_trim(squeeze('l.text'))} AS flat,
    CAST(least(10, 2 + 2 * least(c.n_articles, 1) + 2 * least(c.n_transcripts, 1) + least(c.n_images, 2)
               + CASE WHEN l.quality = 1 THEN 3 ELSE 0 END) AS DOUBLE) AS score,
    CASE l.content_type WHEN 'thread' THEN 'review' WHEN 'video_share' THEN 'video'
         WHEN 'article_share' THEN 'article' WHEN 'image_post' THEN 'fun' ELSE 'knowledge' END AS category
  FROM live l JOIN counts c ON c.id = l.id LEFT JOIN tags t ON t.id = l.id
),
an AS (
  SELECT *,
    CASE category WHEN 'article' THEN 'Read the article' WHEN 'video' THEN 'Watch the video'
         WHEN 'review' THEN 'Read the thread' ELSE 'Skim the post' END AS top_action,
    CASE WHEN score >= 4 THEN CASE WHEN score >= 9 THEN 'now' WHEN score >= 7 THEN 'this-week' ELSE 'someday' END END AS priority,
    {trunc("coalesce(nullif(first_title, ''), flat)", 50)} AS topic,
    {trunc('flat', 280)} AS tldr,
    len(list_filter(string_split(regexp_replace(flat, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '')) AS n_sent
  FROM an0
)"""

ANALYSIS_RULES = f"""
WITH {_CTX_ALL},{_ANALYSIS}
SELECT id AS post_id, category, score, array_to_string(tags, ',') AS tags, topic, tldr, top_action,
       urls[1] AS primary_link, priority, CAST(n_sent AS BIGINT) AS n_insights,
       CAST(len(urls) AS BIGINT) AS n_links
FROM an
"""

_VALIDATED = """
validated AS (
  SELECT id, category, score,
    CASE WHEN CAST(id AS BIGINT) % 25 = 9 THEN 'malformed_json'
         WHEN CAST(id AS BIGINT) % 10 = 4 THEN 'category'
         WHEN CAST(id AS BIGINT) % 10 = 6 THEN 'relevanceScore' END AS reason
  FROM an
)"""

ANALYSIS_VALID = f"""
WITH {_CTX_ALL},{_ANALYSIS},{_VALIDATED}
SELECT id AS post_id, category, score FROM validated WHERE reason IS NULL
"""

ANALYSIS_QUARANTINE = f"""
WITH {_CTX_ALL},{_ANALYSIS},{_VALIDATED}
SELECT id AS post_id, reason FROM validated WHERE reason IS NOT NULL
"""

ANALYSIS_FLAGS = f"""
WITH {_CTX_ALL},{_ANALYSIS}
SELECT id AS post_id, n_articles > 0 AS has_article, n_transcripts > 0 AS has_video, false AS has_thread,
       CAST(length(first_article) AS DOUBLE) AS article_len, CAST(length(first_transcript) AS DOUBLE) AS transcript_len,
       CAST(n_images AS BIGINT) AS n_image_texts
FROM an
"""


def _lit(text: str) -> str:
    """A Python string as a SQL expression (newlines as chr(10))."""
    parts = text.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if text else "''"


TRIAGE_PROMPT = f"""
WITH {POSTS_PAGES}
SELECT id AS post_id,
  {_lit(DEFAULT_TRIAGE_HEAD)} || chr(10) || chr(10) || 'TWEET by @' || author_username || ' (' || author_name || '):' || chr(10)
  || text || chr(10) || chr(10)
  || CASE WHEN len(urls) > 0 THEN 'LINKS FOUND:' || chr(10) || array_to_string(list_transform(urls, lambda u, i: CAST(i AS VARCHAR) || '. ' || u), chr(10))
          ELSE 'No links found.' END
  || chr(10) || chr(10)
  || CASE WHEN len(images) > 0 THEN 'IMAGES: ' || CAST(len(images) AS VARCHAR) || ' image(s) attached' ELSE '' END
  || chr(10) || chr(10)
  || CASE WHEN is_thread THEN 'NOTE: This appears to be part of a thread.' ELSE '' END
  || chr(10) || chr(10) || {_lit(DEFAULT_TRIAGE_TAIL)} AS prompt
FROM posts
"""

TRIAGE_MODEL = f"""
WITH {POSTS_PAGES}
SELECT id AS post_id,
  CASE WHEN is_thread THEN 'thread' WHEN len(urls) > 0 THEN 'article_share' WHEN len(images) > 0 THEN 'image_post' ELSE 'tweet' END AS content_type,
  CASE WHEN len(urls) > 0 THEN 'high' ELSE 'medium' END AS estimated_value
FROM posts
"""

_SEP = _lit(fixed.PROMPT_SECTION_SEP)

ENRICHED_PROMPT = f"""
WITH {_CTX_ALL},
art AS (SELECT post_id, string_agg('### ' || coalesce(nullif(title, ''), url) || chr(10) || {_cut('content', 8000)}, {_SEP} ORDER BY pos) AS s FROM ctx_articles GROUP BY post_id),
trn AS (SELECT post_id, string_agg('### ' || url || chr(10) || {_cut('transcript', 6000)}, {_SEP} ORDER BY pos) AS s FROM ctx_transcripts GROUP BY post_id),
img AS (SELECT post_id, string_agg('### Image ' || CAST(rn AS VARCHAR) || chr(10) || description, chr(10) || chr(10) ORDER BY pos) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pos) AS rn FROM ctx_images) GROUP BY post_id)
SELECT l.id AS post_id,
  concat_ws({_SEP},
    {_lit(fixed.PROMPT_USER_CONTEXT + DEFAULT_USER_CONTEXT)},
    {_lit(fixed.PROMPT_ORIGINAL + "**@")} || l.author_username || '** (' || l.author_name || ')' || chr(10) || chr(10) || l.text
      || chr(10) || chr(10) || '_Content type identified: ' || l.content_type || '_' || chr(10) || '_Estimated value: ' || l.estimated_value || '_',
    {_lit(fixed.PROMPT_ARTICLES)} || art.s,
    {_lit(fixed.PROMPT_TRANSCRIPTS)} || trn.s,
    {_lit(fixed.PROMPT_IMAGES)} || img.s,
    {_lit(fixed.PROMPT_TASK + DEFAULT_TASK)}) AS prompt
FROM live l LEFT JOIN art ON art.post_id = l.id LEFT JOIN trn ON trn.post_id = l.id LEFT JOIN img ON img.post_id = l.id
"""

POLL_OUTCOME = f"""
WITH {_CTX_ALL},{RAW_POSTS_PAGES},
accepted AS (SELECT id FROM (SELECT id, {REASON} AS reason FROM raw_posts) WHERE reason IS NULL),
outcome AS (
  SELECT t.id, CAST(t.id AS BIGINT) AS n, t.estimated_value, coalesce(t.quality = 1, false) AS known,
    CASE WHEN t.id IN (SELECT post_id FROM ctx_articles) THEN 'article'
         WHEN t.id IN (SELECT post_id FROM ctx_transcripts) THEN 'video' ELSE 'knowledge' END AS answer
  FROM tri t JOIN accepted a ON a.id = t.id
),
judged AS (
  SELECT *,
    CASE WHEN known THEN 'known'
         WHEN n % 20 = 5 OR n % 20 = 8 THEN 'failed'
         WHEN estimated_value = 'skip' THEN 'skipped'
         WHEN n % 25 IN (10, 14, 16) THEN 'failed' ELSE 'done' END AS fate
  FROM outcome
)
SELECT id AS post_id, CASE WHEN fate = 'failed' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN fate = 'done' THEN answer ELSE 'review' END AS category, fate = 'done' AS has_page
FROM judged
"""

_JUDGED = POLL_OUTCOME[: POLL_OUTCOME.rindex("SELECT id AS post_id")]

POLL_COUNTERS = _JUDGED + """
SELECT count(*) AS fetched, CAST(0 AS BIGINT) AS skipped,
  (SELECT count(*) FROM raw_posts) - count(*) AS quarantined,
  count(*) FILTER (WHERE fate = 'failed') AS failed, count(*) FILTER (WHERE fate = 'skipped') AS triage_skipped,
  count(*) FILTER (WHERE fate = 'known') AS already_published, count(*) FILTER (WHERE fate = 'done') AS completed
FROM judged
"""

POLL_PAYLOADS = _JUDGED + """
SELECT j.id AS post_id,
  CASE fate WHEN 'failed' THEN '' WHEN 'known' THEN 'tweet,alreadyPublished' WHEN 'skipped' THEN 'tweet,triage,skipped'
       ELSE 'tweet,triage,analysis' END AS parts,
  CASE WHEN fate <> 'failed' THEN j.id END AS tweet_id,
  CASE WHEN fate <> 'failed' THEN sha256(t.text) END AS text_sha,
  CAST(CASE WHEN fate <> 'failed' THEN len(t.urls) ELSE 0 END AS BIGINT) AS n_urls,
  CASE WHEN fate IN ('skipped', 'done') THEN j.estimated_value END AS estimated_value,
  CASE WHEN fate = 'done' THEN answer END AS category
FROM judged j JOIN tri t ON t.id = j.id
"""

_THREAD_POSTS = """
conv AS (
  SELECT conv_id, turn, role, text, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS member_id
  FROM conversations
),
bad AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
saved AS (SELECT c.* FROM conv c JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn WHERE c.role <> 'system'),
others AS (
  SELECT s.member_id AS post_id, m.turn, m.text, row_number() OVER (PARTITION BY s.member_id ORDER BY m.turn) + 1 AS rn
  FROM saved s JOIN conv m ON m.conv_id = s.conv_id AND m.member_id <> s.member_id
  WHERE s.turn > 0 AND s.conv_id NOT IN (SELECT conv_id FROM bad)
)"""

THREAD_PROMPT = f"""
WITH {_THREAD_POSTS},
thr AS (
  SELECT post_id, '## THREAD CONTINUATION (' || count(*) || ' more tweets)' || chr(10)
    || string_agg('[' || rn || '] ' || text, chr(10) || chr(10) ORDER BY rn) AS s
  FROM others GROUP BY post_id
)
SELECT p.member_id AS post_id, concat_ws({_SEP},
  {_lit(fixed.PROMPT_USER_CONTEXT + DEFAULT_USER_CONTEXT)},
  {_lit(fixed.PROMPT_ORIGINAL + "**@")} || role || '** (' || upper(role[1]) || role[2:] || ')' || chr(10) || chr(10) || text
    || chr(10) || chr(10) || '_Content type identified: tweet_' || chr(10) || '_Estimated value: medium_',
  thr.s,
  CASE WHEN text <> '' THEN {_lit(fixed.PROMPT_ARTICLES + "### ")} || chr(10) || {_cut('text', 8000)} END,
  {_lit(fixed.PROMPT_TASK + DEFAULT_TASK)}) AS prompt
FROM saved p LEFT JOIN thr ON thr.post_id = p.member_id
"""

THREAD_FLAGS = f"""
WITH {_THREAD_POSTS}
SELECT member_id AS post_id, length(text) % 2 = 0 AS has_article, text <> '' AS has_video,
  member_id IN (SELECT post_id FROM others) AS has_thread, CAST(length(nullif(text, '')) AS BIGINT) AS transcript_len
FROM saved
"""

# --- step 7: publish, digest, alerts --------------------------------------------------------

_PUB = f"""
pub AS (
  SELECT an.*, v.reason,
    'Related to ' || array_to_string(tags, ', ') AS for_you0
  FROM an JOIN validated v ON v.id = an.id
  WHERE v.reason IS NULL
),
pub2 AS (
  SELECT *, CASE WHEN len(tags) > 0 THEN for_you0 ELSE '' END AS for_you,
         flat AS summary
  FROM pub
)"""

PUBLISH_ROWS = f"""
WITH {_CTX_ALL},{_ANALYSIS},{_VALIDATED},{_PUB},{LEDGER_ROWS}
SELECT id AS post_id, sha256(id) AS page_id,
  {trunc("coalesce(coalesce(nullif(topic, ''), nullif(tldr, '')), summary)", 50)} AS topic,
  score,
  CASE WHEN score >= 9 THEN '🔥🔥🔥' WHEN score >= 7 THEN '🔥🔥' WHEN score >= 4 THEN '🔥' ELSE '' END AS score_visual,
  '@' || author_username AS author, category,
  {trunc('for_you', 250)} AS for_you,
  coalesce(nullif(priority, ''), 'someday') AS priority,
  {trunc('top_action', 100)} AS top_action,
  nullif(urls[1], '') AS primary_link,
  n_articles > 0 AS has_article, n_transcripts > 0 AS has_video, false AS has_thread,
  {trunc('tldr', 280)} AS tldr,
  {trunc('summary', 2000)} AS summary,
  array_to_string(list_slice(tags, 1, 7), ',') AS tags,
  'https://x.com/' || author_username || '/status/' || id AS post_url,
  {iso('created_at')} AS created_at,
  {iso('(SELECT max(processed_at) FROM ledger_rows)')} AS processed_at
FROM pub2
"""

PUBLISH_DEDUP = f"""
WITH {_CTX_ALL},{_ANALYSIS},{_VALIDATED},{_PUB}
SELECT id AS post_id, coalesce(quality = 1, false) AS already_published FROM pub
"""

PUBLISH_BACKLOG = f"""
WITH {LEDGER_CURRENT}
SELECT post_id, category, {iso('processed_at')} AS processed_at FROM ledger_current
WHERE coalesce(status, 'completed') = 'completed' AND page_id IS NULL
"""


def _blk(kind: str, text: str = "NULL", url: str = "NULL", detail: str = "NULL") -> str:
    return f"{{'type': '{kind}', 'text': CAST({text} AS VARCHAR), 'url': CAST({url} AS VARCHAR), 'detail': CAST({detail} AS VARCHAR)}}"


_EMPTY_BLOCKS = "CAST([] AS STRUCT(type VARCHAR, text VARCHAR, url VARCHAR, detail VARCHAR)[])"


def _opt_blk(cond: str, block: str) -> str:
    return f"CASE WHEN {cond} THEN [{block}] ELSE {_EMPTY_BLOCKS} END"


_SENTENCES = "list_filter(string_split(regexp_replace(flat, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '')"

_LINK_ICON = (
    "CASE WHEN nullif(regexp_extract(u, '" + _VID + "', 1), '') IS NOT NULL THEN '🎬' "
    "WHEN regexp_matches(u, 'github\\.com') THEN '📦' ELSE '🔗' END"
)

PAGE_BLOCKS = f"""
WITH {_CTX_ALL},{_ANALYSIS},{_VALIDATED},{_PUB},
blocks AS (
  SELECT id, list_concat(
    [{_blk('paragraph', "CASE WHEN score >= 9 THEN '🔥🔥🔥' WHEN score >= 7 THEN '🔥🔥' WHEN score >= 4 THEN '🔥' ELSE '' END || ' ' || CAST(CAST(score AS BIGINT) AS VARCHAR) || '/10 • @' || author_username || ' • ' || category", "'https://x.com/' || author_username || '/status/' || id")},
     {_blk('paragraph', 'flat')}],
    {_opt_blk("for_you0 IS NOT NULL AND len(tags) > 0", _blk('paragraph', "'💡 ' || for_you0"))},
    [{_blk('divider')}, {_blk('quote', trunc('text', 2000))}],
    list_transform(list_slice(images, 1, 4), lambda u: {_blk('image', url='u')}),
    {_opt_blk("nullif(urls[1], '') IS NOT NULL", _blk('paragraph', "'🔗 ' || urls[1]", 'urls[1]'))},
    list_transform(list_slice({_SENTENCES}, 1, 5), lambda s: {_blk('bulleted_list_item', 's')}),
    list_transform(list_slice(urls, 1, 5), lambda u: {_blk('bulleted_list_item', _LINK_ICON + " || ' ' || " + url_title('u'), 'u')}),
    {_opt_blk("nullif(first_transcript, '') IS NOT NULL", _blk('toggle', "'🎬 Transcript'", detail=trunc('first_transcript', 2000)))},
    {_opt_blk("nullif(first_article, '') IS NOT NULL", _blk('toggle', "'📄 Article'", detail=trunc('first_article', 2000)))}
  ) AS bl
  FROM pub
)
SELECT id AS post_id, CAST(b.pos - 1 AS BIGINT) AS block_no, b.blk.type AS block_type, b.blk.text AS text,
       b.blk.url AS url, b.blk.detail AS detail
FROM blocks, unnest(blocks.bl) WITH ORDINALITY AS b(blk, pos)
"""

# --- answered documents ---

_ANSWERED = f"""
answered AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(text, '') AS text, coalesce(source, 'nobody') AS author,
    list_transform(range(1, doc_id % 7 + 1), lambda i: 'https://img.example.com/' || doc_id || '/' || i || '.jpg') AS images,
    list_transform(range(1, doc_id % 11 + 1), lambda i: coalesce(lang, 'any') || '-' || doc_id || '-' || i) AS tags,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: s <> '') AS lines,
    list_transform(range(1, doc_id % 8 + 1), lambda i: {{'url': 'https://www.example.com/' || doc_id || '/' || i, 'title': 'link ' || i,
      'icon': CASE i % 5 WHEN 0 THEN '🛠️' WHEN 1 THEN '📦' WHEN 2 THEN '🔗' WHEN 3 THEN '🎬' ELSE '📚' END}}) AS links,
    1 + doc_id % 10 AS score,
    CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'video' ELSE 'knowledge' END AS category,
    CASE doc_id % 4 WHEN 1 THEN 'now' WHEN 2 THEN 'this-week' ELSE 'someday' END AS priority
  FROM documents WHERE doc_id % 20 <> 13
)"""

_MARKS = "CASE WHEN score >= 9 THEN '🔥🔥🔥' WHEN score >= 7 THEN '🔥🔥' WHEN score >= 4 THEN '🔥' ELSE '' END"

ANSWERS_PUBLISHED = f"""
WITH {_ANSWERED}
SELECT id AS post_id, {trunc("CASE WHEN doc_id % 5 = 0 THEN lines[1] ELSE text END", 50)} AS topic, CAST(score AS DOUBLE) AS score,
  {_MARKS} AS score_visual, category, priority, CAST(least(len(tags), 7) AS BIGINT) AS n_tags,
  array_to_string(list_slice(tags, 1, 7), ',') AS tags, {trunc("text || text", 250)} AS for_you, {trunc("text", 280)} AS tldr
FROM (SELECT * REPLACE (CASE WHEN len(lines) = 0 THEN [''] ELSE lines END AS lines) FROM answered)
"""

ANSWERS_BLOCKS = f"""
WITH {_ANSWERED},
blocks AS (
  SELECT id, list_concat(
    [{_blk('paragraph', _MARKS + " || ' ' || score || '/10 • @' || author || ' • ' || category", "'https://x.com/' || author || '/status/' || id")},
     {_blk('paragraph', 'text')}],
    {_opt_blk("text <> ''", _blk('paragraph', "'💡 ' || text || text"))},
    [{_blk('divider')}, {_blk('quote', trunc('text', 2000))}],
    list_transform(list_slice(images, 1, 4), lambda u: {_blk('image', url='u')}),
    list_transform(list_slice(lines, 1, 5), lambda s: {_blk('bulleted_list_item', 's')}),
    list_transform(list_slice(links, 1, 5), lambda l: {_blk('bulleted_list_item', "l.icon || ' ' || l.title", 'l.url')}),
    {_opt_blk("doc_id % 2 = 0 AND len(lines) > 0", _blk('toggle', "'💎 Quotes'", detail=trunc("array_to_string(lines, chr(10) || chr(10))", 2000)))},
    {_opt_blk("doc_id % 6 = 0 AND text <> ''", _blk('toggle', "'🎬 Transcript'", detail=trunc('text', 2000)))},
    {_opt_blk("doc_id % 9 = 0 AND text <> ''", _blk('toggle', "'📄 Article'", detail=trunc('text', 2000)))}
  ) AS bl
  FROM answered
)
SELECT id AS post_id, CAST(b.pos - 1 AS BIGINT) AS block_no, b.blk.type AS block_type, b.blk.text AS text,
       b.blk.url AS url, b.blk.detail AS detail
FROM blocks, unnest(blocks.bl) WITH ORDINALITY AS b(blk, pos)
"""

# a third of the posts has an article's text, a fourth a note's; the article's goes first
POST_TEXTS = """
SELECT CAST(doc_id AS VARCHAR) AS post_id,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 6 = 0 THEN ''
       WHEN doc_id % 3 = 0 THEN 'article ' || doc_id
       WHEN doc_id % 4 = 0 THEN 'note ' || doc_id ELSE text END AS text
FROM documents
"""

POLL_TABLES = _JUDGED + """
SELECT id AS post_id, CASE WHEN fate = 'failed' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN fate = 'done' THEN answer ELSE 'review' END AS category,
       CASE WHEN fate = 'done' THEN sha256(id) END AS page_id, CASE WHEN fate = 'done' THEN answer END AS page_category,
       false AS existed_before, true AS exists_now
FROM judged
"""

LEDGER_ADDED_COLUMN = f"""
WITH {LEDGER_ROWS}
SELECT post_id, category, CASE WHEN version % 2 = 0 THEN 'completed' ELSE status END AS status FROM ledger_rows
"""

_DIGEST = f"""
dcats AS (SELECT category, count(*) AS n FROM week GROUP BY category),
dtot AS (SELECT sum(n) AS total, count(*) AS ncat FROM dcats),
digest AS (
  SELECT
    '# 📚 Weekly Bookmark Digest' || chr(10) || chr(10)
    || printf('%d posts saved this week across %d categories.', (SELECT total FROM dtot), (SELECT ncat FROM dtot))
    || coalesce(chr(10) || chr(10) || '## 🎯 Top Picks This Week' || chr(10)
         || (SELECT string_agg('- **' || summary || '**' || chr(10) || '  _high score in ' || category || '_', chr(10) ORDER BY rank)
             FROM highlights WHERE rank <= 3), '')
    || chr(10) || chr(10) || '## 📊 Patterns Noticed' || chr(10)
    || (SELECT string_agg('- ' || category || ': ' || CAST(n AS VARCHAR) || ' posts', chr(10) ORDER BY n DESC, category)
        FROM (SELECT * FROM dcats ORDER BY n DESC, category LIMIT 3))
    || coalesce(chr(10) || chr(10) || '## 💡 Recommendations' || chr(10)
         || (SELECT string_agg('- Revisit: ' || summary, chr(10) ORDER BY rank) FROM highlights), '') AS markdown
  WHERE (SELECT total FROM dtot) > 0
)"""

DIGEST_MARKDOWN = f"""
WITH {WEEK},{_HIGHLIGHTS},{_DIGEST}
SELECT markdown FROM digest
"""

DIGEST_PROMPT = f"""
WITH {WEEK},{_HIGHLIGHTS},
dcats AS (SELECT category, count(*) AS n FROM week GROUP BY category)
SELECT 'Generate a weekly digest for saved posts.' || chr(10) || chr(10) || 'STATS:' || chr(10) || '- Total processed: '
  || CAST((SELECT sum(n) FROM dcats) AS VARCHAR) || chr(10) || '- By category: '
  || (SELECT '{{' || string_agg('"' || category || '":' || CAST(n AS VARCHAR), ',' ORDER BY category) || '}}' FROM dcats)
  || chr(10) || chr(10) || 'TOP HIGHLIGHTS:' || chr(10)
  || coalesce((SELECT string_agg('- [' || category || '] ' || summary, chr(10) ORDER BY rank) FROM highlights), '') AS prompt
WHERE (SELECT count(*) FROM week) > 0
"""

IMAGE_MODEL = f"""
WITH {_CTX_ALL},
asked AS (SELECT DISTINCT url, length(url) % 5 AS n FROM image_texts WHERE url IS NOT NULL)
SELECT url, CASE WHEN n > 2 THEN 'image at ' || url || chr(10) || '🔑 Key elements: sky, sea' END AS description,
  CASE n WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'contentType' WHEN 2 THEN 'keyElements' END AS reason
FROM asked
"""

DIGEST_MODEL = f"""
WITH {WEEK},{_HIGHLIGHTS},
said AS (
  SELECT (SELECT count(*) FROM week) AS total, coalesce((SELECT category FROM highlights ORDER BY rank LIMIT 1), '') AS top
)
SELECT {_lit(fixed.DIGEST_TITLE)} || CAST(total AS VARCHAR) || ' posts were saved.' || {_lit(fixed.DIGEST_TOP_PICKS)}
  || '- **' || top || '**' || chr(10) || '  _newest_' || {_lit(fixed.DIGEST_PATTERNS)} || '- first: ' || top AS markdown
FROM said WHERE total > 0
"""


def _whole(pieces: str) -> str:
    """Non-empty pieces, those over 4096 characters going on in further ones."""
    return f"""flatten(list_transform(list_filter({pieces}, lambda x: x <> ''),
      lambda x: list_transform(range(0, length(x), 4096), lambda i: substring(x, i + 1, 4096))))"""


DIGEST_OUTBOX = f"""
WITH {WEEK},{_HIGHLIGHTS},{_DIGEST},
pieces AS (SELECT {chunk_fold('markdown', fixed.DIGEST_CHUNK)} AS p FROM digest)
SELECT CAST(c.pos - 1 AS BIGINT) AS seq, c.piece AS text, 'Markdown' AS parse_mode
FROM pieces, unnest({_whole('pieces.p')}) WITH ORDINALITY AS c(piece, pos)
"""

DOCUMENT_OUTBOX = f"""
WITH pieces AS (SELECT doc_id, {chunk_fold('text', fixed.DIGEST_CHUNK)} AS p FROM documents)
SELECT doc_id, CAST(c.pos - 1 AS BIGINT) AS seq, sha256(c.piece) AS text_sha, 'HTML' AS parse_mode
FROM pieces, unnest({_whole('pieces.p')}) WITH ORDINALITY AS c(piece, pos)
"""

_ICON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.ERROR_ICONS.items())

ERROR_ALERTS = f"""
WITH {LEDGER_BASE},
e AS (
  SELECT event_id, user_id % 5 <> 0 AS auth_valid, k % 3 <> 0 AS from_source,
    CASE WHEN k % 4 = 0 THEN 'rate limit exceeded 429' WHEN k % 4 = 1 THEN 'connect ETIMEDOUT <proxy & dns>'
         WHEN k % 4 = 2 THEN 'unknown command "bookmarks"' ELSE 'HTTP 429 from upstream' END AS raw
  FROM ledger_base WHERE event_type = 'error'
),
c AS (
  SELECT *,
    CASE WHEN NOT from_source THEN 'UNKNOWN'
         WHEN contains(raw, 'rate limit') OR contains(raw, '429') THEN 'RATE_LIMIT'
         WHEN contains(raw, 'unknown command') THEN 'UNKNOWN' ELSE 'NETWORK' END AS code
  FROM e
),
m AS (
  SELECT *, code <> 'UNKNOWN' AS retryable,
    CASE WHEN NOT from_source THEN raw WHEN code = 'RATE_LIMIT' THEN {_lit(fixed.ERROR_RATE_LIMIT)} WHEN code = 'UNKNOWN' THEN {_lit(fixed.ERROR_UNKNOWN_COMMAND)}
         ELSE {_lit(fixed.ERROR_NETWORK_PREFIX)} || raw END AS message
  FROM c
)
SELECT event_id, code, retryable,
  CASE WHEN code IN ('NETWORK', 'UNKNOWN') AND NOT auth_valid THEN 'auth_expired' ELSE 'error' END AS alert_kind,
  left(CASE WHEN code IN ('NETWORK', 'UNKNOWN') AND NOT auth_valid THEN {_lit(fixed.ALERT_AUTH)}
       ELSE (CASE code {_ICON} ELSE '{fixed.ERROR_ICON_DEFAULT}' END) || ' <b>Curation Error</b>' || chr(10) || chr(10)
            || '<b>Type:</b> ' || code || chr(10) || '<b>Message:</b> '
            || replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10)
            || '<b>Status:</b> ' || CASE WHEN retryable THEN '(will retry)' ELSE '(manual action needed)' END END, 4096) AS text
FROM m
"""

RUN_METRICS = f"""
WITH {LEDGER_CURRENT},{_BLOCKED},{POSTS_PAGES},{_TRIAGE},
f AS (
  SELECT t.id, EXISTS (SELECT 1 FROM blocked b WHERE b.post_id = t.id) AS blocked, t.estimated_value = 'skip' AS triage_skip
  FROM tri t
)
SELECT count(*) AS fetched, count(*) FILTER (WHERE blocked) AS skipped, count(*) FILTER (WHERE NOT blocked) AS claimed,
       count(*) FILTER (WHERE NOT blocked AND triage_skip) AS triage_skipped,
       count(*) FILTER (WHERE NOT blocked AND NOT triage_skip) AS analysed
FROM f
"""

# --- step 8: streaming -------------------------------------------------------------------------

STREAM_INGEST = f"""
WITH {LEDGER_ROWS}
SELECT post_id, {iso('processed_at')} AS processed_at, category, status, version FROM ledger_rows
"""

STREAM_NEW_POSTS = f"""
WITH {LEDGER_CURRENT},{_BLOCKED},{POSTS_PAGES}
SELECT id AS post_id, 'processing' AS status, 'review' AS category FROM posts_pages p
WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.post_id = p.id)
"""

STREAM_RETRY = f"""
WITH {LEDGER_ROWS},{POSTS_PAGES},
asked AS (
  SELECT id AS post_id FROM posts_pages UNION SELECT post_id FROM ledger_rows WHERE status = 'failed'
)
SELECT post_id, 'processing' AS status, 'review' AS category FROM asked a
WHERE post_id NOT IN (SELECT l.post_id FROM ledger_rows l WHERE l.status <> 'failed')
"""

STATS_MESSAGE = f"""
WITH {LEDGER_ROWS}
SELECT {_lit(fixed.STATS_TITLE)} || 'Total processed: ' || count(*) || chr(10) || 'Today: '
       || count(*) FILTER (WHERE CAST(processed_at AS DATE) = (SELECT CAST(max(processed_at) AS DATE) FROM ledger_rows))
       || chr(10) || 'Errors: ' || count(*) FILTER (WHERE status = 'failed') AS text
FROM ledger_rows
"""

STREAM_WEEKLY = f"""
WITH {LEDGER_ROWS},
w AS (
  SELECT time_bucket(INTERVAL 7 DAY, processed_at, TIMESTAMP '1970-01-01 00:00:00') AS ws, category
  FROM ledger_rows
)
SELECT {iso('ws')} AS window_start, {iso('ws + INTERVAL 7 DAY')} AS window_end, category, count(*) AS n
FROM w GROUP BY ws, category
"""

STREAM_DEDUP = f"""
WITH saves AS (
  SELECT page_id, 0 AS h FROM pages
  UNION ALL SELECT page_id, 1 FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 200 FROM pages WHERE page_id % 5 = 0
),
timed AS (SELECT page_id, h, page_id + h AS hour FROM saves),
bounds AS (SELECT min(hour) * 3600 AS lo, max(hour) * 3600 AS hi FROM timed),
sliced AS (SELECT *, ((hour * 3600 - lo) * 6) // (hi - lo + 1) AS slice FROM timed, bounds),
batched AS (SELECT page_id, h, hour, dense_rank() OVER (ORDER BY slice) AS b FROM sliced),
newest AS (SELECT b, max(max(hour)) OVER (ORDER BY b) AS m FROM batched GROUP BY b)
SELECT CAST(page_id AS VARCHAR) AS post_id, {iso("(TIMESTAMP '2024-01-01 00:00:00' + to_hours(hour))")} AS saved_at
FROM batched s LEFT JOIN newest n ON n.b = s.b - 2
-- a key is forgotten two hours after it passed, by the watermark (newest less two
-- hours) of the batches before the last one
WHERE h = 0 OR (h = 200 AND n.m - 2 >= page_id + 2)
"""

STREAM_WEEKLY_WATERMARK = f"""
WITH arrived AS (
  SELECT event_type AS category, ts, ts + CASE WHEN event_id % 20 = 0 THEN INTERVAL 15 DAY ELSE INTERVAL 0 DAY END AS came FROM events
),
bounds AS (SELECT min(CAST(floor(epoch(came)) AS BIGINT)) AS lo, max(CAST(floor(epoch(came)) AS BIGINT)) AS hi FROM arrived),
sliced AS (SELECT category, ts, ((CAST(floor(epoch(came)) AS BIGINT) - lo) * 6) // (hi - lo + 1) AS slice FROM arrived, bounds),
batched AS (
  SELECT category, ts, dense_rank() OVER (ORDER BY slice) AS b,
         time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01 00:00:00') AS ws
  FROM sliced
),
newest AS (SELECT b, max(max(ts)) OVER (ORDER BY b) AS m FROM batched GROUP BY b),
told AS (
  SELECT r.category, r.ws,
         CASE WHEN r.ws + INTERVAL 7 DAY <= n.m - INTERVAL 2 DAY THEN 'late'
              WHEN r.ws + INTERVAL 7 DAY <= (SELECT max(m) FROM newest) - INTERVAL 2 DAY THEN 'closed' END AS kind
  FROM batched r LEFT JOIN newest n ON n.b = r.b - 2
)
SELECT kind, {iso('ws')} AS window_start, category, CAST(count(*) AS BIGINT) AS n FROM told WHERE kind IS NOT NULL GROUP BY ALL
"""

STREAM_DIGESTS = f"""
WITH {LEDGER_ROWS},
weeks AS (
  SELECT post_id, processed_at, category, {ANALYSIS_COLS},
         time_bucket(INTERVAL 7 DAY, processed_at, TIMESTAMP '1970-01-01 00:00:00') AS ws
  FROM ledger_rows
),
closed AS (
  SELECT DISTINCT ws FROM weeks WHERE ws + INTERVAL 7 DAY <= (SELECT max(processed_at) FROM ledger_rows) - INTERVAL 1 DAY
),
dcats AS (
  SELECT ws, category, count(*) AS n, row_number() OVER (PARTITION BY ws ORDER BY count(*) DESC, category) AS place
  FROM weeks GROUP BY ws, category
),
dtot AS (SELECT ws, sum(n) AS total, count(*) AS ncat FROM dcats GROUP BY ws),
patterns AS (
  SELECT ws, string_agg('- ' || category || ': ' || CAST(n AS VARCHAR) || ' posts', chr(10) ORDER BY place) AS t
  FROM dcats WHERE place <= 3 GROUP BY ws
),
hl AS (
  SELECT * FROM (
    SELECT ws, category, coalesce(summary, '') AS summary,
           row_number() OVER (PARTITION BY ws ORDER BY processed_at DESC, post_id DESC) AS rank
    FROM weeks WHERE score >= 8)
  WHERE rank <= 10
),
picks AS (
  SELECT ws, string_agg('- **' || summary || '**' || chr(10) || '  _high score in ' || category || '_', chr(10) ORDER BY rank) AS t
  FROM hl WHERE rank <= 3 GROUP BY ws
),
recs AS (SELECT ws, string_agg('- Revisit: ' || summary, chr(10) ORDER BY rank) AS t FROM hl GROUP BY ws),
made AS (
  SELECT c.ws,
    {_lit(fixed.DIGEST_TITLE)}
    || printf('%d posts saved this week across %d categories.', d.total, d.ncat)
    || coalesce({_lit(fixed.DIGEST_TOP_PICKS)} || k.t, '')
    || {_lit(fixed.DIGEST_PATTERNS)} || p.t
    || coalesce({_lit(fixed.DIGEST_RECOMMENDATIONS)} || r.t, '') AS markdown
  FROM closed c JOIN dtot d USING (ws) JOIN patterns p USING (ws) LEFT JOIN picks k USING (ws) LEFT JOIN recs r USING (ws)
),
pieces AS (SELECT ws, {chunk_fold('markdown', fixed.DIGEST_CHUNK)} AS p FROM made)
SELECT strftime(ws, '%Y-%m-%d') AS week, CAST(c.pos - 1 AS BIGINT) AS seq, c.piece AS text, 'Markdown' AS parse_mode
FROM pieces, unnest({_whole('pieces.p')}) WITH ORDINALITY AS c(piece, pos)
"""

ORACLE: dict[str, str] = {
    "answers_published": ANSWERS_PUBLISHED,
    "answers_blocks": ANSWERS_BLOCKS,
    "post_texts": POST_TEXTS,
    "poll_tables": POLL_TABLES,
    "ledger_added_column": LEDGER_ADDED_COLUMN,
    "stream_dedup": STREAM_DEDUP,
    "stream_weekly_watermark": STREAM_WEEKLY_WATERMARK,
    "stream_digests": STREAM_DIGESTS,
    "stream_quarantine": INGEST_QUARANTINE,
    "new_posts_bucketed": NEW_POSTS,
    "stream_ingest": STREAM_INGEST,
    "stream_new_posts": STREAM_NEW_POSTS,
    "stream_weekly": STREAM_WEEKLY,
    "stream_retry": STREAM_RETRY,
    "caption_files": TRANSCRIPT_CLEAN,
    "bookmark_files": INGEST_VALID,
    "stats_message": STATS_MESSAGE,
    "poll_outcome": POLL_OUTCOME,
    "poll_counters": POLL_COUNTERS,
    "image_model": IMAGE_MODEL,
    "digest_model": DIGEST_MODEL,
    "poll_payloads": POLL_PAYLOADS,
    "thread_prompt": THREAD_PROMPT,
    "thread_flags": THREAD_FLAGS,
    "bookmark_arrays": INGEST_VALID,
    "triage_model": TRIAGE_MODEL,
    "document_outbox": DOCUMENT_OUTBOX,
    "publish_rows": PUBLISH_ROWS,
    "publish_dedup": PUBLISH_DEDUP,
    "publish_backlog": PUBLISH_BACKLOG,
    "page_blocks": PAGE_BLOCKS,
    "digest_markdown": DIGEST_MARKDOWN,
    "digest_prompt": DIGEST_PROMPT,
    "digest_outbox": DIGEST_OUTBOX,
    "error_alerts": ERROR_ALERTS,
    "run_metrics": RUN_METRICS,
    "article_parse": ARTICLE_PARSE,
    "article_markdown": ARTICLE_MARKDOWN,
    "enriched_articles": ENRICHED_ARTICLES,
    "enriched_transcripts": ENRICHED_TRANSCRIPTS,
    "enriched_images": ENRICHED_IMAGES,
    "image_descriptions": IMAGE_DESCRIPTIONS,
    "thread_expand": THREAD_EXPAND,
    "video_info": VIDEO_INFO,
    "triage_rules": TRIAGE_RULES,
    "triage_skip": TRIAGE_SKIP,
    "analysis_rules": ANALYSIS_RULES,
    "analysis_valid": ANALYSIS_VALID,
    "analysis_quarantine": ANALYSIS_QUARANTINE,
    "analysis_flags": ANALYSIS_FLAGS,
    "triage_prompt": TRIAGE_PROMPT,
    "enriched_prompt": ENRICHED_PROMPT,
    "message_chunks": MESSAGE_CHUNKS,
    "url_classes": URL_CLASSES,
    "video_ids": VIDEO_IDS,
    "truncate_text": TRUNCATE_TEXT,
    "transcript_clean": TRANSCRIPT_CLEAN,
    "html_escape": HTML_ESCAPE,
    "ledger_current": LEDGER_CURRENT_Q,
    "ledger_upsert": LEDGER_CURRENT_Q,
    "ledger_release": LEDGER_RELEASE,
    "new_posts": NEW_POSTS,
    "claimable_posts": CLAIMABLE_POSTS,
    "processed_posts": PROCESSED_POSTS,
    "locked_posts": LOCKED_POSTS,
    "ingest_valid": INGEST_VALID,
    "ingest_quarantine": INGEST_QUARANTINE,
    "post_lookup": POST_LOOKUP,
    "post_urls": POST_URLS,
    "post_mentions": POST_MENTIONS,
    "post_media": POST_MEDIA,
    "best_variant": BEST_VARIANT,
    "newest_posts": NEWEST_POSTS,
    "weekly_by_category": WEEKLY_BY_CATEGORY,
    "weekly_top_tags": WEEKLY_TOP_TAGS,
    "weekly_highlights": WEEKLY_HIGHLIGHTS,
    "weekly_report": WEEKLY_REPORT,
    "ledger_stats": LEDGER_STATS,
    "ledger_health": LEDGER_HEALTH,
}
