"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from alertloom.config import Rules
from checks.inputs import AS_OF_TEXT, PAGE_RULES, QUERIES, RULES, SETTINGS

NOW = f"TIMESTAMP '{AS_OF_TEXT}'"
WS = r"[\t-\r\x1c-\x20]"
SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


def norm_text(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{WS}+', ' ', 'g')))"


def norm_url(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '[?#].*$', ''), '/+$', ''))"


def key_of(url: str = "url", company: str = "company", title: str = "title") -> str:
    return f"sha256({norm_url(url)} || '|' || {norm_text(company)} || '|' || {norm_text(title)})"


def posted(id_col: str) -> str:
    return f"CASE WHEN {id_col} % 5 <> 0 THEN {NOW} - to_hours(CAST({id_col} * 7 % 400 AS BIGINT)) END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def hit(text: str, term: str) -> str:
    body = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in term)
    left = r"(^|[^\p{L}\p{N}_])" if term[0].isalnum() else ""
    right = r"($|[^\p{L}\p{N}_])" if term[-1].isalnum() else ""
    case = "" if term.lower() == "it" else "(?i)"
    return f"regexp_matches({text}, {q(case + left + body + right)})"


def any_hit(text: str, terms) -> str:
    return "(" + " OR ".join(hit(text, t) for t in terms) + ")"


def hit_list(text: str, terms) -> str:
    cases = ", ".join(f"CASE WHEN {hit(text, t)} THEN {q(t.lower())} END" for t in terms)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def joined(x: str, by: str = ",") -> str:
    return f"array_to_string({x}, {q(by)})"


def truncate(x: str, n: int) -> str:
    text = strip(x)
    return (f"CASE WHEN length({text}) <= {n} THEN {text} "
            f"ELSE regexp_replace(left({text}, {n - 3}), '{WS}+$', '') || '...' END")


def age_text(x: str) -> str:
    secs = f"(epoch_us({NOW}) - epoch_us({x})) / 1000000.0"
    days = f"CAST(floor({secs} / 86400) AS BIGINT)"
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown Date' WHEN {secs} < 3600 THEN 'posted less than 1 hour ago' "
            f"WHEN {secs} < 86400 THEN 'posted ' || CAST(floor({secs} / 3600) AS BIGINT) || ' hours ago' "
            f"ELSE 'posted ' || {days} || ' day' || CASE WHEN {days} = 1 THEN '' ELSE 's' END || ' ago' END")


TITLE = strip("split_part(text, chr(10), 1)")
LISTINGS = f"""l AS (SELECT doc_id AS seq, source, {TITLE} AS title, upper(lang) AS company, lang AS location,
  'https://' || lang || '.example/job/' || (n_chars // 20) AS url, {posted('doc_id')} AS posted_at,
  text AS summary, text FROM documents)"""
HAY = "title || ' ' || company || ' ' || location || ' ' || summary"


def relevant(rules: Rules) -> str:
    barred = f"({any_hit('title', rules.excluded)} AND NOT {any_hit('title', rules.terms)})"
    parts = [any_hit(HAY, x) for x in (rules.locations, rules.terms, rules.skills)]
    return f"title <> '' AND url <> '' AND {' AND '.join(parts)} AND NOT {barred}"


YOUNG = f"(posted_at IS NULL OR posted_at >= {NOW} - INTERVAL {SETTINGS.max_age_days} DAY)"
FRESH = (f"CASE WHEN posted_at IS NULL THEN 2 WHEN posted_at >= {NOW} - INTERVAL {SETTINGS.priority_hours} HOUR THEN 0 "
         f"WHEN posted_at >= {NOW} - INTERVAL {SETTINGS.max_age_days} DAY THEN 1 ELSE 9 END")


def scored(rules: Rules, where: str = "true", reason: str | None = None) -> str:
    """CTEs from ``l`` to ``s``: relevant rows with score, rank, reason, skills."""
    boosts = "".join(
        "WHEN " + " OR ".join(f"contains(lower(title), {q(w)})" for w in words) + f" THEN {points} "
        for words, points in rules.title_boosts)
    boost = f"CASE {boosts}ELSE 0 END" if boosts else "0"
    return f"""m AS (SELECT *, {hit_list(HAY, rules.locations)} AS locs, {hit_list(HAY, rules.terms)} AS terms,
  {hit_list(HAY, rules.skills)} AS skills FROM l WHERE {where} AND {relevant(rules)}),
s AS (SELECT *, list_sort(list_distinct(skills)) AS matched_skills, {FRESH} AS freshness_rank,
  least(100, CASE WHEN len(terms) > 0 THEN 25 ELSE 0 END + CASE WHEN len(locs) > 0 THEN 20 ELSE 0 END
    + least(30, 5 * len(list_distinct(skills)))
    + CASE {FRESH} WHEN 2 THEN 5 WHEN 0 THEN 25 WHEN 1 THEN 15 ELSE 0 END + {boost}) AS match_score,
  concat_ws('; ',
    CASE WHEN len(terms) > 0 THEN 'internship term: ' || {joined('list_sort(list_distinct(terms))[1:3]', ', ')} END,
    CASE WHEN len(locs) > 0 THEN {q(rules.location_reason)} END,
    CASE WHEN len(skills) > 0 THEN 'skills: ' || {joined('list_sort(list_distinct(skills))[1:5]', ', ')} END,
    {age_text('posted_at')}) AS match_reason,
  {key_of()} AS dedupe_key, {norm_url('url')} AS norm_url, {norm_text('company')} AS norm_company FROM m)"""


BEST = """b AS (SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY dedupe_key) AS key_slot,
  row_number() OVER (PARTITION BY dedupe_key ORDER BY match_score DESC, seq) AS rn FROM s) WHERE rn = 1)"""
COLLAPSE = """c AS (SELECT * FROM (SELECT * EXCLUDE (rn), min(key_slot) OVER (PARTITION BY norm_url, norm_company) AS slot,
  row_number() OVER (PARTITION BY norm_url, norm_company ORDER BY match_score DESC, key_slot) AS rn2 FROM b) WHERE rn2 = 1)"""
ORDER = "freshness_rank, coalesce(epoch_us(posted_at), 0) DESC, match_score DESC, slot"
RANK = f"r AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place FROM c)"


def ranked(rules: Rules) -> str:
    return f"{scored(rules, YOUNG)}, {BEST}, {COLLAPSE}, {RANK}"


# --- text and addresses -------------------------------------------------------

HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
SQL["norm_url"] = f"""SELECT page_id, {norm_url('url')} AS norm_url, trim(split_part(url, '#', 1)) AS detail_url,
  {HOST} AS host FROM pages"""
SQL["norm_text_dups"] = f"""SELECT sha256({norm_text('text')}) AS text_key, count(*) AS copies, min(doc_id) AS first_doc
  FROM documents GROUP BY 1 HAVING count(*) > 1"""
SQL["dedupe_key"] = f"WITH {LISTINGS} SELECT seq, {key_of()} AS dedupe_key FROM l"
SQL["form_encode"] = "SELECT doc_id, sha256(replace(url_encode(text), '%20', '+')) AS encoded_sha FROM documents"
SQL["truncate"] = f"SELECT doc_id, {truncate('text', 256)} AS short, left(text, 800) AS head FROM documents"


def decoded(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name}(;|([^-.;a-zA-Z0-9])|$)', {q(char + chr(92) + '2')}, 'g')"
    return x


def visible(x: str) -> str:
    bare = (f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<![^>]*>', '<>', 'g')")
    pieces = f"list_transform(string_split_regex({bare}, '<[^<>]*>'), lambda p: {strip(decoded('p'))})"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), ' ')"


ANCHORS = f"""a AS (SELECT page_id, url, i, {decoded("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href,
  {strip(decoded("regexp_extract(tag, '(?s)>(.*)</a>', 1)"))} AS text
  FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM (SELECT page_id, url,
    regexp_extract_all(html, '(?s)<a href=.*?</a>') AS tags FROM pages)))"""
SQL["page_text"] = f"SELECT page_id, {visible('html')} AS visible FROM pages"
SQL["page_anchors"] = f"WITH {ANCHORS} SELECT page_id, href, text, count(*) AS n FROM a GROUP BY ALL"
_TAGS = ("regexp_extract_all(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script>)', '\\1\\2', 'g'), "
         "'<([a-z][a-z0-9]*)[\\s/>]', 1)")
SQL["page_elements"] = f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest({_TAGS}) AS tag FROM pages) GROUP BY ALL"
# the place of a link among all elements: tags opened before it
SQL["url_join"] = f"""WITH t AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM (
    SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script>)', '\\1\\2', 'g'),
    '<[a-z][a-z0-9]*(?:\\s[^>]*)?/?>') AS tags FROM pages)),
  w AS (SELECT page_id, pos, url, substr({decoded("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")}, 2) AS word,
    regexp_extract(url, '^(https?)', 1) AS scheme, {HOST} AS host, {PATH} AS path,
    regexp_replace({PATH}, '[^/]*$', '') AS dir FROM t WHERE starts_with(tag, '<a ')),
  f AS (SELECT page_id, pos, unnest([
    scheme || '://' || host || '/' || word,
    CASE WHEN word = '' THEN url ELSE scheme || '://' || host || dir || word END,
    scheme || '://' || host || path || '?q=' || word,
    scheme || '://' || host || path || coalesce('?' || nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '')
      || CASE WHEN word = '' THEN '' ELSE '#' || word END,
    scheme || '://o.example/' || word,
    scheme || '://' || host || regexp_replace(dir, '[^/]+/$', '') || word,
    scheme || '://' || host || dir || 'y/' || word]) AS joined, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) - 1 AS form FROM w)
  SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(form AS BIGINT) AS form, joined FROM f"""

# --- dates ----------------------------------------------------------------------

SQL["age_text"] = f"WITH {LISTINGS} SELECT seq, {age_text('posted_at')} AS age, CAST({FRESH} AS BIGINT) AS freshness_rank FROM l"
_DAY = "date_trunc('day', o_orderdate)"
SQL["parse_date"] = f"""SELECT o_orderkey, {stamp(f'''CASE o_orderkey % 10
  WHEN 0 THEN {_DAY} WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate - INTERVAL 2 HOUR
  WHEN 3 THEN o_orderdate - INTERVAL 1 HOUR WHEN 4 THEN {_DAY} WHEN 5 THEN {_DAY} WHEN 6 THEN {_DAY}
  WHEN 7 THEN {NOW} - to_days(CAST(o_orderkey % 90 + 1 AS INTEGER))
  WHEN 8 THEN {NOW} - to_days(CAST((o_orderkey % 50 + 2) * 7 AS INTEGER)) END''')} AS read FROM orders"""
_SWAP = ("CASE WHEN day(o_orderdate) <= 12 THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) "
         f"ELSE {_DAY} END")
_AGO = f"{NOW} - to_days(CAST(o_orderkey % 20 + 1 AS INTEGER))"
SQL["infer_date"] = f"""SELECT o_orderkey, {stamp(f'''CASE o_orderkey % 6 WHEN 0 THEN {_AGO} WHEN 1 THEN {_SWAP}
  WHEN 2 THEN {_SWAP} WHEN 3 THEN {_AGO} WHEN 4 THEN {_DAY} END''')} AS read FROM orders"""
SQL["iso_parse"] = "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(epoch_us(ts) AS VARCHAR) END AS micros FROM events"

# --- matching -------------------------------------------------------------------

SQL["term_matches"] = f"""WITH {LISTINGS} SELECT seq, {joined(hit_list(HAY, RULES.locations))} AS locations,
  {joined(hit_list(HAY, RULES.terms))} AS terms, {joined(hit_list(HAY, RULES.skills))} AS skills FROM l"""
SQL["default_rules"] = f"""WITH {LISTINGS} SELECT seq, {joined(hit_list(HAY, Rules().terms))} AS terms,
  {joined(hit_list(HAY, Rules().skills))} AS skills FROM l"""
SQL["relevance"] = f"WITH {LISTINGS} SELECT seq FROM l WHERE {relevant(RULES)}"
def _marked(x: str) -> str:
    """A mark on both sides of all that is no word character, so that borders are part of the text."""
    return f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', chr(2) || '\\1' || chr(2), 'g')"


SQL["match_rule_table"] = f"""WITH d AS (SELECT doc_id, text, {TITLE} AS title FROM documents),
  said AS (SELECT doc_id, chr(2) || {_marked("lower(text || coalesce(' ' || p_name || '+', ''))")} || chr(2) AS marked
    FROM d LEFT JOIN part ON doc_id = p_partkey),
  raw AS (SELECT 'openings' AS list, array_to_string(string_split(title, ' ')[1:2], ' ') AS term, doc_id AS pos FROM d
    UNION ALL SELECT 'names', p_name, p_partkey FROM part
    UNION ALL SELECT 'words', unnest(string_split(p_name, ' ')), p_partkey * 2 + generate_subscripts(string_split(p_name, ' '), 1) - 1 FROM part
    UNION ALL SELECT 'signs', string_split(p_name, ' ')[-1] || '+', p_partkey FROM part),
  t AS (SELECT list, trim(regexp_replace(lower(term), '{WS}+', ' ', 'g')) AS label, min(pos) AS pos FROM raw GROUP BY list, lower(term)),
  p AS (SELECT *, CASE WHEN regexp_matches(label, '^[\\p{{L}}\\p{{N}}]') THEN chr(2) ELSE '' END || trim({_marked("label")}, chr(2))
    || CASE WHEN regexp_matches(label, '[\\p{{L}}\\p{{N}}]$') THEN chr(2) ELSE '' END AS pattern FROM t WHERE label <> '')
  SELECT doc_id, list, string_agg(label, ',' ORDER BY pos) AS hits FROM said JOIN p ON contains(marked, pattern) GROUP BY doc_id, list"""
SQL["term_matches_table"] = SQL["term_matches"]
SQL["relevance_table"] = SQL["relevance"]
SQL["age_filter"] = f"WITH {LISTINGS} SELECT seq, title FROM l WHERE title <> '' AND {YOUNG}"
SQL["score"] = f"""WITH {LISTINGS}, {scored(RULES)} SELECT seq, CAST(match_score AS BIGINT) AS match_score,
  CAST(freshness_rank AS BIGINT) AS freshness_rank, {joined('matched_skills')} AS matched_skills FROM s"""
SQL["match_reason"] = f"WITH {LISTINGS}, {scored(RULES)} SELECT seq, match_reason FROM s"

# --- duplicates, ranking, messages -------------------------------------------------

EVENTS = """s AS (SELECT user_id || '|' || event_type || '|' || (props ->> '$.k') AS dedupe_key, CAST(user_id AS VARCHAR) AS norm_url,
  event_type AS norm_company, CAST(trunc(value) AS BIGINT) AS match_score, event_id % 3 AS freshness_rank,
  CASE WHEN event_id % 3 <> 2 THEN ts END AS posted_at, event_id AS seq FROM events)"""
SQL["best_per_key"] = f"WITH {EVENTS}, {BEST} SELECT dedupe_key, seq, match_score, key_slot FROM b"
SQL["collapse_url_company"] = f"WITH {EVENTS}, {BEST}, {COLLAPSE} SELECT norm_url, norm_company, seq, match_score, slot FROM c"
SQL["rank_topn"] = f"WITH {EVENTS}, {BEST}, {COLLAPSE}, {RANK} SELECT place, seq, dedupe_key FROM r WHERE place <= 40"
SQL["anti_seen"] = f"""WITH {EVENTS}, {BEST} SELECT dedupe_key, seq FROM b WHERE dedupe_key NOT IN (
  SELECT user_id || '|view|' || (props ->> '$.k') FROM events WHERE event_type = 'purchase')"""
SQL["anti_seen_log"] = SQL["anti_seen"]
SQL["rank_documents"] = f"""WITH {LISTINGS}, {ranked(RULES)} SELECT place, seq, CAST(match_score AS BIGINT) AS match_score,
  CAST(freshness_rank AS BIGINT) AS freshness_rank, match_reason FROM r WHERE place <= 40"""


def digest(first: int = 0) -> str:
    """CTE ``d``: digest rows of ``r`` after place ``first``."""
    return f"""d AS (SELECT place, CAST((place - 1) // 10 AS BIGINT) AS chunk, {truncate('title', 256)} AS title, url,
  {truncate('match_reason', 300)} AS description,
  CAST(CASE freshness_rank WHEN 0 THEN {0x2ECC71} WHEN 1 THEN {0xF1C40F} ELSE {0x95A5A6} END AS BIGINT) AS color,
  {truncate("coalesce(nullif(company, ''), 'Unknown Company')", 200)} AS company,
  {truncate("coalesce(nullif(location, ''), 'Casablanca/Morocco')", 200)} AS location,
  {age_text('posted_at')} AS posted, match_score || '/100' AS score,
  {truncate(f"coalesce(nullif({joined('matched_skills', ', ')}, ''), '-')", 200)} AS skills,
  {truncate('source', 100)} AS source, {truncate('url', 400)} AS url_text, '#' || place AS footer
  FROM (SELECT * REPLACE (place - {first} AS place) FROM r WHERE place > {first} AND place <= {first + 40}))"""


SQL["digest_chunks"] = f"WITH {LISTINGS}, {ranked(RULES)}, {digest()} SELECT * FROM d"


def _field(name: str, col: str, inline: str = "true") -> str:
    return (f"'{{\"name\":\"{name}\",\"value\":' || CAST(to_json({col}) AS VARCHAR) || ',\"inline\":{inline}}}'")


_FIELDS = " || ',' || ".join([
    _field("Company", "company"), _field("Location", "location"), _field("Posted", "posted"), _field("Match Score", "score"),
    _field("Skills", "skills"), _field("Source", "source"), _field("URL", "url_text", "false")])
_EMBED = ("'{\"title\":' || CAST(to_json(title) AS VARCHAR) || ',\"url\":' || CAST(to_json(url) AS VARCHAR) || ',\"description\":' "
          "|| CAST(to_json(description) AS VARCHAR) || ',\"color\":' || color || ',\"fields\":[' || " + _FIELDS +
          " || '],\"footer\":{\"text\":\"' || footer || '\"}}'")
SQL["digest_messages"] = f"""WITH {LISTINGS}, {ranked(RULES)}, {digest()} SELECT chunk,
  '{{"content":"Internship Opportunities Found","embeds":[' || string_agg({_EMBED}, ',' ORDER BY place) || ']}}' AS message
  FROM d GROUP BY chunk"""

# --- pages ------------------------------------------------------------------------

_FIRST = f"""{ANCHORS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS k
  FROM (SELECT * FROM a WHERE contains(href, '/')){{guard}}) WHERE k = 1)"""
_ANCHOR_ROWS = """SELECT page_id AS task_id, page_id * 2147483648 + row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq,
  text AS title, 'Unknown Company' AS company, 'Morocco' AS location,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS url, text AS summary FROM u"""
SQL["pipe_anchor_listings"] = f"WITH {_FIRST.format(guard='')} {_ANCHOR_ROWS} WHERE length(text) >= 6"
SQL["boxed_anchor_listings"] = f"WITH {_FIRST.format(guard=' WHERE length(text) >= 6')} {_ANCHOR_ROWS}"
ARTICLES = f"""l AS (SELECT page_id AS seq, 'pages' AS source, {visible("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
  {HOST} AS company, regexp_extract(html, '<html lang="([^"]*)"', 1) AS location, url, {posted('page_id')} AS posted_at,
  {visible("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS summary FROM pages)"""
SQL["page_articles"] = f"""WITH {ARTICLES} SELECT seq, title, company, location, url, summary, {stamp('posted_at')} AS posted FROM l"""
SQL["top_listings"] = f"""WITH {ARTICLES}, {ranked(PAGE_RULES)} SELECT place, seq, title, company, location, url,
  CAST(match_score AS BIGINT) AS match_score, CAST(freshness_rank AS BIGINT) AS freshness_rank,
  {stamp('posted_at')} AS posted, match_reason FROM r WHERE place <= 40"""

DOCS = f"""d AS (SELECT doc_id, source, lang, text, {TITLE} AS t, {strip('text')} AS body, doc_id * 7 % 30 + 1 AS n,
  {posted('doc_id')} AS dated, 'https://' || source || '.example' AS site FROM documents)"""
_SAID = f"{NOW} - to_days(CAST(n AS INTEGER))"


def _words(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda p: p <> ''), ' ')"


_PIPE = strip("replace(t, '|', '/') || ' | ' || lang || ' (Maroc)'")
_LEVEL = strip("t || ' Niveau d''études: Bac+5'")
_POSTED = "'posted ' || n || ' days ago.'"
# kind: where, title, company, location, url, posted, summary
EXTRACTED = {
    "json_ld": ("true", "t", "source", "lang || ' X'", "site || '/offre/' || doc_id", "dated", "body"),
    "cards": ("t = '' OR length(t) >= 4", "CASE WHEN t = '' THEN 'open' ELSE t END", "source", "lang",
              "site || '/offre?id=' || doc_id", "dated", f"{_words('t', q('open'), 'source', 'lang', 'body')}"),
    "wordpress": ("length(t) >= 6", "t", "'Unknown Company'", "lang", "site || '/offre/' || doc_id", "dated", "body"),
    "rekrute": ("true", f"coalesce(nullif({strip(chr(114) + 'eplace(t, ' + q('|') + ', ' + q('/') + ')')}, ''), {_PIPE})",
                "source || ' group'", "lang",
                "site || '/offre-emploi-x-recrutement-' || source || '-group-' || lang || '-' || doc_id || '.html?r=1'",
                "NULL::TIMESTAMP", _PIPE),
    "marocannonces": ("true", f"coalesce(nullif(t, ''), {_LEVEL})", "'Unknown Company'", "lang",
                      "site || '/list/cat/annonce/' || doc_id || '/x.html'", _SAID,
                      f"{_words(_POSTED, _LEVEL, 'body')}"),
    "talent": (f"length({strip('regexp_replace(t, ' + q(WS + '+') + ', chr(32), chr(103))')}) >= 6",
               "trim(regexp_replace(t, '" + WS + "+', ' ', 'g'))", "'Talent Co'", "lang", "site || '/view?id=' || doc_id", _SAID,
               f"{_words(_POSTED, 't', q('view'), 'body')}"),
    "successfactors": ("true", "CASE WHEN length(t) >= 6 THEN t ELSE 'again again' END", "'Unknown Company'", "lang",
                       "site || '/JobDetail/' || doc_id", _SAID,
                       f"{_words(_POSTED, 't', q('again again'), 'body')}"),
    "rss": ("length(t) >= 4", "t", "source", "lang", "'https://f.example/' || doc_id", "dated", "body"),
}
for _kind, (_where, _title, _company, _location, _url, _at, _summary) in EXTRACTED.items():
    SQL[f"extract_{_kind}"] = f"""WITH {DOCS} SELECT doc_id * 2147483648 AS seq, source, {_title} AS title, {_company} AS company,
  {_location} AS location, {_url} AS url, {stamp(_at)} AS posted, {_summary} AS summary FROM d WHERE {_where}"""
_KINDS = ("wordpress", "rekrute", "marocannonces", "talent", "successfactors", "rss", "cards")
SQL["extract_all_kinds"] = f"WITH {DOCS} " + " UNION ALL ".join(
    f"SELECT doc_id * 2147483648 AS seq, {EXTRACTED[k][1]} AS title, {EXTRACTED[k][4]} AS url FROM d "
    f"WHERE doc_id % 7 = {i} AND ({EXTRACTED[k][0]})" for i, k in enumerate(_KINDS))
SQL["detail_dates"] = f"""WITH {DOCS} SELECT doc_id AS task_id, {stamp(f'''CASE doc_id % 4 WHEN 0 THEN dated WHEN 1 THEN {_SAID}
  WHEN 2 THEN TIMESTAMP '2024-01-15' END''')} AS found FROM d"""
_SEG = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"
SQL["infer_company"] = f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN {_SEG} || ' Group' WHEN 1 THEN {_SEG}
  WHEN 2 THEN {_SEG} ELSE '' END AS company FROM customer"""

# --- requests -----------------------------------------------------------------------

SOURCES = f"""src AS (SELECT p_partkey AS source_pos, p_brand AS name,
  CASE p_size % 7 WHEN 0 THEN false ELSE true END AS enabled,
  CASE WHEN p_type <> 'SMALL' THEN lower(p_type) ELSE 'generic' END AS kind,
  CASE p_size % 4 WHEN 0 THEN 'https://' || p_partkey || '.example/?q={{query}}' WHEN 1 THEN 'https://x.example/all'
    WHEN 2 THEN 'https://static.example/' || p_partkey END AS template,
  CASE WHEN p_size % 3 > 0 THEN p_type ELSE 'Morocco' END AS default_location,
  CASE WHEN p_size % 2 > 0 THEN p_brand ELSE '' END AS company,
  CASE WHEN p_size % 4 <> 0 THEN [''] WHEN p_size % 5 = 0 THEN string_split(p_name, ' ')
    ELSE [{', '.join(q(x) for x in QUERIES)}] END AS asked FROM part)"""


def plan_sql(where: str = "true", limit: str = "") -> str:
    return f"""WITH {SOURCES}, e AS (SELECT *, unnest(asked{limit}) AS query, generate_subscripts(asked{limit}, 1) AS pos FROM src
    WHERE enabled AND template IS NOT NULL AND {where})
  SELECT row_number() OVER (ORDER BY source_pos, pos) - 1 AS id, name AS source, kind,
    replace(template, '{{query}}', replace(url_encode(query), '%20', '+')) AS url, query, default_location, company FROM e"""


SQL["request_plan_all"] = plan_sql()
SQL["request_plan_chosen"] = plan_sql("name IN ('Brand#2', 'Brand#17')", "[1:1]")
SQL["lane_plan_pages"] = f"""WITH h AS (SELECT page_id AS id, {HOST} AS host FROM pages)
  SELECT id, host, row_number() OVER (PARTITION BY host ORDER BY id) AS slot,
  CAST((row_number() OVER (PARTITION BY host ORDER BY id) - 1) * 0.5 AS DOUBLE) AS earliest_offset_s,
  CAST(greatest(1, least(8, (SELECT count(DISTINCT host) FROM h))) AS BIGINT) AS lanes FROM h"""
SQL["url_policy_pages"] = f"""WITH p AS (SELECT page_id AS id, {HOST} AS host, {PATH} AS path,
    regexp_replace(url, '^https?://[^/?#]*|#.*$', '', 'g') AS rest FROM pages),
  rules AS (SELECT host, id * 2 AS rule_pos, path AS prefix, id % 3 = 0 AS allow FROM p UNION ALL
    SELECT host, id * 2 + 1, regexp_extract(path, '^/[a-z]+'), id % 2 = 0 FROM p)
  SELECT p.id, p.host, coalesce(arg_min(r.allow, r.rule_pos), true) AS allowed FROM p
  LEFT JOIN rules r ON r.host = p.host AND starts_with(p.rest, r.prefix) GROUP BY p.id, p.host"""
SQL["page_scan"] = """SELECT page_id AS task_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '/moved' END AS page_url,
  sha256(html) AS html_sha FROM pages WHERE page_id % 4 <> 0"""

# --- counts --------------------------------------------------------------------------

SQL["source_breakdown"] = f"""WITH {LISTINGS}, x AS (SELECT source, count(*) AS requests, count(*) FILTER (seq % 4 = 0) AS failed,
    count(*) AS jobs_extracted, count(*) FILTER ({relevant(RULES).replace("title <> '' AND url <> '' AND ", "")}) AS relevant,
    count(*) FILTER (seq % 12 = 0) AS n1, count(*) FILTER (seq % 12 = 4) AS n2, count(*) FILTER (seq % 12 = 8) AS n3
  FROM l GROUP BY source)
  SELECT source, requests, failed, jobs_extracted, relevant, array_to_string(list_concat(
    list_transform(range(n1), lambda i: 'robots.txt disallow'), list_transform(range(n2), lambda i: 'HTTP 403'),
    list_transform(range(n3), lambda i: 'HTTP 429')), '; ') AS notes FROM x"""
SQL["funnel"] = f"""WITH {LISTINGS}, {ranked(RULES)} SELECT 'raw' AS step, count(*) AS rows FROM l
  UNION ALL SELECT 'relevant', count(*) FROM s UNION ALL SELECT 'new_unique', count(*) FROM c
  UNION ALL SELECT 'returned', least(40, count(*)) FROM c"""
SQL["undated_groups"] = f"""WITH {LISTINGS} SELECT url AS detail_url, count(*) AS rows, min(seq) AS first_seq FROM l
  WHERE posted_at IS NULL GROUP BY url"""
SQL["date_check"] = f"""WITH {LISTINGS}, k AS (SELECT l.seq, {key_of()} AS key, url, posted_at,
    CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) AS n FROM l),
  pairs AS (SELECT DISTINCT key, url, n FROM k WHERE posted_at IS NULL AND key NOT IN (SELECT key FROM k WHERE seq % 10 = 0)),
  cand AS (SELECT DISTINCT url, n FROM pairs),
  checked AS (SELECT url, CASE WHEN n % 4 <> 1 THEN {NOW} - to_days(CAST(n % 30 + 1 AS INTEGER)) END AS found FROM cand WHERE n % 3 <> 0)
  SELECT k.seq, {stamp('coalesce(k.posted_at, p.found)')} AS posted FROM k
  LEFT JOIN (SELECT key, pairs.url, found FROM pairs JOIN checked USING (url)) p
    ON k.posted_at IS NULL AND p.key = k.key AND p.url = k.url
  WHERE k.posted_at IS NOT NULL OR k.url NOT IN (SELECT url FROM checked WHERE found IS NULL)"""

SQL["date_check_limited"] = SQL["date_check"].replace("SELECT DISTINCT url, n FROM pairs)", "SELECT DISTINCT url, n FROM pairs ORDER BY url LIMIT 20)")

# --- state, sinks, streams --------------------------------------------------------------

KEYS = """k AS (SELECT user_id, event_type, user_id || '|' || event_type AS dedupe_key,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS first_seen, max(ts) AS ts FROM events GROUP BY ALL)"""
_STAMPED = f"strftime({NOW}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"
SQL["seen_prune"] = f"""WITH {KEYS} SELECT dedupe_key, CASE WHEN user_id % 9 = 0 THEN 'unknown' ELSE first_seen END AS first_seen
  FROM k WHERE user_id % 9 = 0 OR ts >= {NOW} - INTERVAL 3 DAY"""
SQL["seen_merge"] = f"""WITH {KEYS} SELECT dedupe_key, CASE WHEN event_type IN ('purchase', 'click') THEN {_STAMPED}
  ELSE first_seen END AS first_seen FROM k"""
SQL["seen_json"] = f"""WITH {KEYS} SELECT dedupe_key, CASE WHEN user_id % 5 = 0 THEN {_STAMPED} ELSE first_seen END AS first_seen
  FROM k WHERE user_id % 5 = 0 OR user_id % 7 <> 0"""
SQL["seen_versions"] = f"WITH {KEYS} SELECT dedupe_key, first_seen FROM k WHERE ts >= {NOW} - INTERVAL 3 DAY"
SQL["seen_log"] = f"""WITH {KEYS} SELECT dedupe_key, CASE WHEN event_type = 'purchase' THEN {_STAMPED} ELSE first_seen END AS first_seen
  FROM k WHERE event_type = 'purchase' OR ts >= {NOW} - INTERVAL 3 DAY"""
SQL["raw_dump"] = f"""WITH {LISTINGS} SELECT source, title, company, location, url,
  strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS posted_at, sha256(summary) AS summary_sha FROM l"""
_WP = EXTRACTED["wordpress"]
WORDPRESS = f"""{DOCS}, l AS (SELECT doc_id * 2147483648 AS seq, source, {_WP[1]} AS title, {_WP[2]} AS company, {_WP[3]} AS location,
  {_WP[4]} AS url, dated AS posted_at, {_WP[6]} AS summary FROM d WHERE {_WP[0]})"""
_DIGEST_OUT = "SELECT place, chunk, title, url, description, color, company, posted, score, skills, source FROM d2"
SQL["alert_run_batch"] = f"WITH {WORDPRESS}, {ranked(RULES)}, {digest(40).replace('d AS', 'd2 AS', 1)} {_DIGEST_OUT}"
SQL["run_funnel"] = SQL["funnel"].replace(LISTINGS, WORDPRESS)
SQL["incremental_alerts"] = "\nUNION ALL ".join(
    f"SELECT * FROM (WITH {WORDPRESS}, {ranked(RULES)}, {digest(40 * (n + 1)).replace('d AS', 'd2 AS', 1)} "
    f"{_DIGEST_OUT.replace('SELECT ', f'SELECT CAST({n} AS BIGINT) AS batch, ')})" for n in range(3))
SQL["ttl_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"

SQL["page_errors"] = """SELECT doc_id AS task_id, source,
  CASE doc_id % 3 WHEN 1 THEN 'not well-formed XML' ELSE 'not a feed' END AS error FROM documents WHERE doc_id % 3 > 0"""
SQL["extract_many_cards"] = """SELECT doc_id // 150 AS task_id, 'Offer ' || doc_id AS title,
  'https://site.example/o/' || doc_id AS url FROM documents"""
SQL["extract_late_words"] = f"""WITH {DOCS} SELECT doc_id AS task_id,
  sha256({_words(q('Offer at the end'), 'body', "'posted ' || n || chr(160) || 'days ago'")}) AS summary_sha FROM d"""
SQL["extract_loose_feeds"] = """SELECT doc_id AS task_id, 'R&D' || chr(160) || 'café ' || doc_id AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'https://f.example/' || doc_id ELSE '' END AS url, 'a & b & c' AS summary FROM documents"""
SQL["extract_atom"] = f"""WITH {DOCS} SELECT doc_id AS task_id, 'Entry ' || doc_id AS title, source AS company,
  'https://f.example/' || doc_id AS url, {stamp('dated')} AS posted, lang AS summary FROM d"""
SQL["page_scan_planned"] = SQL["page_scan"]
SQL["page_scan_bucketed"] = SQL["page_scan"]
SQL["feed_files"] = f"""SELECT CASE WHEN doc_id // 50 % 2 = 0 THEN 'Item ' ELSE 'Entry ' END || doc_id AS title, 'https://f.example/' || doc_id AS link,
  source AS author, sha256({norm_text('text')}) AS summary_sha, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS place FROM documents"""
SQL["seen_json_files"] = f"WITH {KEYS} SELECT dedupe_key, first_seen FROM k"
SQL["digest_files"] = f"SELECT message FROM ({SQL['digest_messages']})"
# kept for five days, a key goes when the clock is ten days past it, which is three periods later
SQL["ttl_dedupe_again"] = """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, least(4, (day(ts) - 1) // 6) AS period FROM events),
  r AS (SELECT user_id, event_type, min(period) AS period FROM e GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT r.user_id, r.event_type, min(e.period) AS period FROM r JOIN e ON e.user_id = r.user_id
      AND e.event_type = r.event_type AND e.period >= r.period + 3 GROUP BY r.user_id, r.event_type))
  SELECT user_id, event_type, CAST(period AS BIGINT) AS period FROM r"""
