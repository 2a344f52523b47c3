"""What the named queries must give, in DuckDB SQL over the same tables; written apart from the Spark expressions."""

from __future__ import annotations

from crawlsight.operators.catalogue import CATALOGUE

# Macros are not at hand, so parts that come often are put together here.

HOST = r"lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1))"
BARE = r"regexp_replace(regexp_replace(" + HOST + r", ':.*$', ''), '^www\.', '')"
SITE = r"regexp_extract(" + BARE + r", '([^.]+\.[^.]+)$', 1)"
PATH = r"regexp_extract(regexp_replace({u}, '#.*$', ''), '^[a-z]+://[^/?]*(/[^?]*)?', 1)"
QUERY = r"CASE WHEN contains(regexp_replace({u}, '#.*$', ''), '?') THEN regexp_replace(regexp_replace({u}, '#.*$', ''), '^[^?]*\?', '') ELSE '' END"
STYLE = (
    "CASE WHEN " + PATH + " IN ('', '/') OR regexp_matches(regexp_extract(rtrim(" + PATH + r", '/'), '([^/]*)$', 1), '\.[A-Za-z0-9]{1,5}$') THEN '' "
    "WHEN " + PATH + " LIKE '%/' THEN 'slash' ELSE 'noslash' END"
)


def on(template: str, u: str = "url") -> str:
    return template.replace("{u}", u)


def key(u: str, fold: bool = False) -> str:
    """Key of a page without escapes in its path."""
    path = on(PATH, u)
    path = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    path = rf"regexp_replace({path}, '(?i)/index\.(html?|php|aspx?)$', '/')"
    path = f"CASE WHEN rtrim({path}, '/') = '' THEN '/' ELSE rtrim({path}, '/') END"
    path = f"lower({path})" if fold else path
    query = on(QUERY, u)
    return f"{on(BARE, u)} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


P = f"SELECT page_id, url, {on(SITE)} AS site_id FROM pages"
LISTED = f"""
p AS ({P}),
spelled AS (
  SELECT site_id, page_id, 0 AS k, url FROM p
  UNION ALL SELECT site_id, page_id, 1, regexp_replace(url, '^http:', 'https:') FROM p WHERE page_id % 4 = 0
  UNION ALL SELECT site_id, page_id, 2, regexp_replace(url, '://www\\.', '://') FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT site_id, page_id, 3, regexp_replace(url, '/(en|de|fr|es)/', '/EN/', 'g') FROM p WHERE page_id % 6 = 0
  UNION ALL SELECT site_id, page_id, 4, url || '#x' FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT site_id, page_id, 5, regexp_replace(url, '^([^?#]*[^/?#])([?#].*)?$', '\\1/index.html\\2') FROM p WHERE page_id % 8 = 0),
-- The array of spellings loses its gaps, so a spelling's place is its rank among those there are.
placed AS (SELECT site_id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, url FROM spelled),
listed AS (SELECT site_id, url, min(page_id * 10 + k) AS seen FROM placed GROUP BY site_id, url)"""
ENTRIES = f"""
p AS ({P}),
twice AS (
  SELECT site_id, page_id, url AS loc, page_id % 7 AS sm_order FROM p
  UNION ALL SELECT site_id, page_id, url, (page_id + 3) % 7 FROM p WHERE page_id % 5 = 0),
entries AS (
  SELECT *, 'https://www.' || site_id || '/sitemap-' || sm_order || '.xml' AS sm_url,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE '2024-0' || (page_id % 9 + 1) || '-15' END AS lastmod FROM twice)"""
ANSWERS = f"""
answers AS (
  SELECT {on(SITE)} AS site_id, page_id, url, page_id % 11 <> 0 AS crawled, [200, 200, 301, 404, 503, 0][page_id % 6 + 1] AS status,
    strlen(html)::BIGINT AS size_bytes, (page_id % 50) / 10.0::DOUBLE AS time_s, page_id % 3 AS retries, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END AS occurrences
  FROM pages)"""
STATUS_TEXT = "CASE status WHEN 0 THEN 'No response (timeout / network error)' WHEN 200 THEN 'OK' WHEN 301 THEN 'Moved Permanently' WHEN 404 THEN 'Not Found' WHEN 503 THEN 'Service Unavailable' END"
FOUND = (
    ANSWERS
    + f""",
found AS (
  SELECT site_id, url, 0 AS stage, 'DUPLICATE_URL' AS code, 'warning' AS severity, 2 AS rank, 'listed 2 times in a | b' AS message FROM answers WHERE occurrences > 1
  UNION ALL SELECT site_id, url, 1, 'URL_NO_RESPONSE', 'error', 3, 'timeout' || CASE WHEN retries > 0 THEN ' (after ' || retries || ' retries)' ELSE '' END FROM answers WHERE crawled AND status = 0
  UNION ALL SELECT site_id, url, 2, 'URL_RETRIED', 'notice', 1, 'ok after ' || retries || ' retries' FROM answers WHERE crawled AND status <> 0 AND retries > 0
  UNION ALL SELECT site_id, url, 3, 'URL_HTTP_ERROR', 'error', 3, status || ' ' || {STATUS_TEXT} FROM answers WHERE crawled AND status >= 400
  UNION ALL SELECT site_id, url, 4, 'URL_REDIRECT', 'warning', 2, '301 -> https://www.example.com/moved' FROM answers WHERE crawled AND status = 301
  UNION ALL SELECT site_id, url, 5, 'SLOW_RESPONSE', 'warning', 2, printf('%.2fs', time_s) || ' (threshold 3s)' FROM answers WHERE crawled AND status <> 0 AND time_s > 3
  UNION ALL SELECT site_id, url, 6, 'PAGE_TOO_LARGE', 'warning', 2, size_bytes || ' bytes (threshold 1500)' FROM answers WHERE crawled AND status <> 0 AND size_bytes > 1500)"""
)
TITLES = "titles(code, title) AS (VALUES " + ", ".join(f"('{d.code}', '{d.title}')" for d in CATALOGUE if d.group in ("status", "redirects", "performance", "duplicates")) + ")"
HELD = (
    ENTRIES
    + ","
    + FOUND
    + """,
held AS (
  SELECT DISTINCT e.site_id, e.sm_order, a.url, a.crawled, a.status FROM entries e JOIN answers a ON a.site_id = e.site_id AND a.url = e.loc WHERE e.sm_order <> 6)"""
)
W3C = r"'^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$'"
TS = "strptime(shift, '%Y-%m-%d %H:%M:%S')"
RULES = {
    "*": [("/de/", False, "starts_with(target, '/de/')"), ("/de/1", True, "starts_with(target, '/de/1')"), ("/*.html$", False, "target LIKE '/%.html'"), ("/*?*ref=", False, r"regexp_matches(target, '^/.*\?.*ref=')")],
    "googlebot": [("/fr/", False, "starts_with(target, '/fr/')"), ("/*page=", True, "target LIKE '/%page=%'"), ("/en/9", False, "starts_with(target, '/en/9')")],
}
_VERDICT = " UNION ALL ".join(f"SELECT page_id, '{agent}' AS agent, {len(raw)} AS size, {str(allow).lower()} AS allow, '{'Allow' if allow else 'Disallow'}: {raw}' AS rule FROM t WHERE {test}" for agent, rules in RULES.items() for raw, allow, test in rules)
_OTHERS = lambda k: f"""SELECT a.site_id, a.url, b.url AS other, row_number() OVER (PARTITION BY a.site_id, a.url ORDER BY b.seen) AS n, count(*) OVER (PARTITION BY a.site_id, a.url) AS total
  FROM keyed a JOIN keyed b ON a.site_id = b.site_id AND a.{k} = b.{k} AND a.url <> b.url"""  # noqa: E731
_SHOWN = "'also listed as ' || string_agg(other, ', ' ORDER BY n) || CASE WHEN max(total) > 3 THEN ' (+' || (max(total) - 3) || ' more)' ELSE '' END"
_TITLE_OF = lambda tag: rf"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '[\x00-\x20\x7F]+', ' ', 'g'))"

ORACLES = {
    "url_parts": f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {on(HOST)} AS host, {on(PATH)} AS path, {on(QUERY)} AS query FROM pages",
    "url_normalize": r"""
SELECT page_id,
  CASE WHEN regexp_matches(bare, '^[a-z]+://[^/?]*$') THEN bare || '/' WHEN regexp_matches(bare, '^[a-z]+://[^/?]*\?') THEN regexp_replace(bare, '^([a-z]+://[^/?]*)\?', '\1/?') ELSE bare END AS normal,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/' AS home,
  CASE WHEN regexp_matches(ported, '^[a-z]+://[^/?]*$') THEN ported || '/' WHEN regexp_matches(ported, '^[a-z]+://[^/?]*\?') THEN regexp_replace(ported, '^([a-z]+://[^/?]*)\?', '\1/?') ELSE ported END AS with_port
FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare, regexp_replace(regexp_replace(url, '#.*$', ''), '^http://([^/?]*)', 'http://\1:443') AS ported FROM pages)""",
    "url_encode": "SELECT page_id, url || '%20%C3%A9%22%3Cx%3E%7C%20' AS encoded FROM pages",
    "url_absolute": f"SELECT page_id, page_id % 4 IN (1, 3) AS absolute, {on(HOST)} AS hostname FROM pages",
    "page_key": f"""
SELECT page_id, {key("url")} AS key, {key("upper_url", True)} AS folded,
  {key("url")} AS of_index
FROM (SELECT page_id, url, regexp_replace(upper(url), '^HTTP(S?)', 'http') AS upper_url FROM pages)""".replace(key("upper_url", True), f"lower(split_part({key('url')}, '?', 1)) || CASE WHEN contains({key('url')}, '?') THEN '?' || upper({on(QUERY)}) ELSE '' END"),
    "slash_style": f"SELECT page_id, {on(STYLE)} AS style FROM pages",
    "url_sections": f"""
SELECT page_id, path, {on(BARE)} AS host, path = '/en' OR starts_with(path, '/en/') OR starts_with(path, '/en?') AS under_en,
  {on(HOST)} || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS id
FROM (SELECT *, CASE WHEN rest = '' OR starts_with(rest, '#') THEN '/' ELSE rest END AS path FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest FROM pages))""",
    "http_url": f"WITH {LISTED} SELECT site_id, url, 'HTTP_URL' AS code, 'http:// on an https site' AS message FROM listed WHERE url LIKE 'http://%'",
    "host_variant": f"""
WITH {LISTED}
SELECT site_id, url, 'HOST_VARIANT' AS code, CASE WHEN host = site_id THEN host || ' instead of www.' || site_id || ' (www / non-www)' ELSE 'other host ' || host || ' (site: www.' || site_id || ')' END AS message
FROM (SELECT *, {on(HOST)} AS host FROM listed) WHERE host <> 'www.' || site_id""",
    "trailing_slash": f"""
WITH {LISTED},
styled AS (SELECT *, {on(STYLE)} AS style FROM listed),
votes AS (SELECT site_id, count(*) FILTER (style = 'slash') AS slash, count(*) FILTER (style = 'noslash') AS noslash FROM styled GROUP BY site_id)
SELECT s.site_id, url, 'TRAILING_SLASH' AS code, CASE WHEN style = 'slash' THEN 'ends with / while ' || noslash || ' of ' || (slash + noslash) || ' URLs do not'
  ELSE 'no trailing / while ' || slash || ' of ' || (slash + noslash) || ' URLs have one' END AS message
FROM styled s JOIN votes v ON v.site_id = s.site_id WHERE (style = 'slash' AND noslash > slash) OR (style = 'noslash' AND slash > noslash)""",
    "tracking_and_query_params": f"""
WITH {LISTED},
q AS (SELECT site_id, url, {on(QUERY)} AS query FROM listed),
named AS (SELECT *, list_transform(list_filter(regexp_split_to_array(query, '[&;]'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)) AS names FROM q WHERE query <> ''),
tracked AS (SELECT *, list_filter(names, lambda n: regexp_matches(n, '(?i)^(utm_[a-z]+|gclid|fbclid)$')) AS track FROM named)
SELECT site_id, url, CASE WHEN len(track) > 0 THEN 'TRACKING_PARAMS' ELSE 'QUERY_PARAMS' END AS code,
  CASE WHEN len(track) > 0 THEN array_to_string(track, ', ') WHEN strlen(query) <= 80 THEN '?' || query ELSE '?' || left(query, 80) || '...' END AS message
FROM tracked WHERE len(names) > 0""",
    "near_duplicate": f"""
WITH {LISTED},
keyed AS (SELECT *, {key("url")} AS key, {key("url", True)} AS fold FROM listed),
near AS ({_OTHERS("key")}), folded AS ({_OTHERS("fold")}),
shown AS (SELECT site_id, url, {_SHOWN.replace("string_agg(other, ', ' ORDER BY n)", "string_agg(other, ', ' ORDER BY n) FILTER (n <= 3)")} AS message FROM near GROUP BY site_id, url),
cased AS (SELECT site_id, url, {_SHOWN.replace("string_agg(other, ', ' ORDER BY n)", "string_agg(other, ', ' ORDER BY n) FILTER (n <= 3)")} AS message FROM folded GROUP BY site_id, url)
SELECT site_id, url, 'NEAR_DUPLICATE' AS code, message FROM shown
UNION ALL SELECT site_id, url, 'CASE_VARIANT', message FROM cased c WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.site_id = c.site_id AND s.url = c.url)""",
    "loc_checks": rf"""
WITH x AS (
  SELECT page_id, url, {on(SITE)} AS site_id, {on(HOST)} AS host, page_id % 2 = 0 AS in_robots, page_id % 4 <> 0 AS whole, page_id % 5 = 0 AS odd, page_id % 3 = 0 AS blank,
    CASE WHEN page_id % 4 = 0 THEN (CASE WHEN rest = '' OR starts_with(rest, '#') THEN '/' ELSE rest END) ELSE url END || CASE WHEN page_id % 5 = 0 THEN ' ü' ELSE '' END AS loc
  FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest FROM pages)),
y AS (SELECT *, regexp_extract(regexp_replace(replace(loc, ' ü', '%20%C3%BC'), '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1) AS path FROM x)
SELECT page_id, 'LOC_WHITESPACE' AS code, 'whitespace around "' || loc || '"' AS message FROM y WHERE blank
UNION ALL SELECT page_id, 'LOC_NOT_ENCODED', '"' || loc || '" must be percent-encoded' FROM y WHERE odd
UNION ALL SELECT page_id, 'LOC_NOT_ABSOLUTE', '"' || loc || '" is not an absolute http(s) URL' FROM y WHERE NOT whole
UNION ALL SELECT page_id, 'LOC_FRAGMENT', '#' || regexp_extract(loc, '#(.*)$', 1) FROM y WHERE whole AND contains(loc, '#')
UNION ALL SELECT page_id, 'LOC_CROSS_HOST', 'on ' || host || ', the sitemap on www.' || site_id FROM y WHERE whole AND host <> 'www.' || site_id AND host <> 'blog.example.com'
UNION ALL SELECT page_id, 'LOC_OUT_OF_SCOPE', 'not under /en/, where the sitemap is' FROM y
  WHERE whole AND (host = 'www.' || site_id OR host = 'blog.example.com') AND NOT in_robots AND NOT starts_with(path, '/en/')""",
    "lastmod_checks": f"""
WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS form, o_orderdate + to_days((o_orderkey % 12000)::INT) AS t FROM orders),
y AS (
  SELECT *, CASE form WHEN 0 THEN strftime(t, '%Y') WHEN 1 THEN strftime(t, '%Y-%m') WHEN 2 THEN strftime(t, '%Y-%m-%d') WHEN 3 THEN strftime(t, '%Y-%m-%dT%H:%MZ')
      WHEN 4 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+03:00') WHEN 5 THEN strftime(t, '%d.%m.%Y') WHEN 6 THEN strftime(t, '%Y-%m-%d %H:%M:%S') ELSE strftime(t, '%Y-13-%d') END AS value,
    CASE form WHEN 0 THEN date_trunc('year', t) WHEN 1 THEN date_trunc('month', t) WHEN 2 THEN date_trunc('day', t) WHEN 3 THEN date_trunc('minute', t) WHEN 4 THEN date_trunc('second', t) - INTERVAL 3 HOUR END AS meant FROM x)
SELECT o_orderkey, value, coalesce(epoch(meant)::BIGINT, 0) AS seconds, CASE WHEN meant IS NULL THEN 'LASTMOD_INVALID' WHEN meant > TIMESTAMP '2024-06-02 12:00:00' THEN 'LASTMOD_FUTURE' END AS code FROM y""",
    "priority_checks": """
WITH x AS (SELECT CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN ' 0.5' WHEN 3 THEN '1.' || l_partkey WHEN 4 THEN 'high' ELSE printf('%.2f', l_discount) END AS value FROM lineitem)
SELECT value, count(*) AS n, coalesce(value = 'NaN' OR (value NOT LIKE ' %' AND try_cast(value AS DOUBLE) BETWEEN 0 AND 1), false) AS valid FROM x GROUP BY value""",
    "changefreq_checks": """
WITH x AS (SELECT unnest([event_type, ['daily', 'Daily', 'never', 'sometimes'][event_id % 4 + 1]]) AS value FROM events)
SELECT value, count(*) AS n, value IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never') AS valid FROM x GROUP BY value""",
    "hreflang_codes": """
WITH l AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang || suffix AS tag, n, CASE WHEN message IS NULL THEN NULL ELSE '"' || lang || suffix || '"' || replace(message, 'LANG', lang) END AS error
FROM l, (VALUES ('', NULL), ('-US', NULL), ('-gb', NULL), ('-UK', ': the region code of the United Kingdom is GB'), ('-419', NULL), ('_US', ' uses _ instead of -'), ('-Latn', NULL), ('-Latn-DE', NULL),
  ('-ZZ', ': "ZZ" is not an ISO 3166-1 region code'), ('-USA', ': "USA" is not an ISO 3166-1 region code'), ('-US-x', ' has too many subtags'), ('x', ': "LANGx" is not an ISO 639-1 language code')) AS s(suffix, message)""",
    "hreflang_reciprocal": rf"""
WITH p AS ({P}),
n AS (SELECT *, CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]*$') THEN b || '/' ELSE b END AS norm FROM (SELECT *, regexp_replace(url, '#.*$', '') AS b FROM p)),
a AS (SELECT DISTINCT f.site_id, f.url, f.norm, t.norm AS alternate FROM n f JOIN n t ON t.page_id IN (f.page_id + 1, f.page_id - 1) WHERE f.page_id % 3 <> 0),
winner AS (SELECT site_id, norm, arg_max(url, page_id) AS url FROM n GROUP BY site_id, norm)
SELECT a.site_id, a.url, CASE WHEN w.url IS NULL THEN 'HREFLANG_ALTERNATE_UNLISTED' ELSE 'HREFLANG_NOT_RECIPROCAL' END AS code,
  a.alternate || CASE WHEN w.url IS NULL THEN ' is not in the sitemaps' ELSE ' does not link back' END AS message
FROM a LEFT JOIN winner w ON w.site_id = a.site_id AND w.norm = a.alternate
WHERE a.alternate <> a.norm AND (w.url IS NULL OR NOT EXISTS (SELECT 1 FROM a b WHERE b.site_id = a.site_id AND b.url = w.url AND b.alternate = a.norm))""",
    "extension_checks": """
SELECT page_id, code, count(*) AS n FROM (
  SELECT page_id, 'IMAGE_INVALID' AS code FROM pages WHERE page_id % 2 <> 0
  UNION ALL SELECT page_id, 'VIDEO_MISSING_FIELD' FROM pages
  UNION ALL SELECT page_id, 'VIDEO_INVALID' FROM pages WHERE page_id * 100 NOT BETWEEN 1 AND 28800
  UNION ALL SELECT page_id, 'VIDEO_INVALID' FROM pages WHERE (page_id % 70) / 10.0 > 5
  UNION ALL SELECT page_id, 'NEWS_MISSING_FIELD' FROM pages WHERE page_id % 4 = 0
  UNION ALL SELECT page_id, 'NEWS_INVALID' FROM pages WHERE page_id % 5 IN (1, 4)
  UNION ALL SELECT page_id, 'NEWS_INVALID' FROM pages WHERE page_id % 3 = 2
  UNION ALL SELECT page_id, 'NEWS_STALE' FROM pages WHERE page_id % 3 = 1) GROUP BY page_id, code""",
    "alternate_checks": """
SELECT page_id, code, count(*) AS n FROM (
  SELECT page_id, 'HREFLANG_INVALID' AS code FROM pages
  UNION ALL SELECT page_id, 'HREFLANG_INVALID' FROM pages
  UNION ALL SELECT page_id, 'HREFLANG_INVALID' FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'HREFLANG_CONFLICT' FROM pages WHERE page_id % 2 <> 0 AND NOT contains(url, '#')
  UNION ALL SELECT page_id, 'HREFLANG_NO_SELF' FROM pages WHERE page_id % 2 <> 0 AND page_id % 3 = 0 AND NOT contains(url, '#')) GROUP BY page_id, code""",
    "url_aggregate": f"""
WITH {ENTRIES},
f AS (SELECT site_id, loc, sm_url, min(sm_order) AS sm_order FROM entries GROUP BY site_id, loc, sm_url)
SELECT e.site_id, e.loc AS url, count(*) AS occurrences, any_value(g.found_in) AS found_in, coalesce(arg_min(lastmod, sm_order) FILTER (lastmod <> ''), '') AS lastmod, min(sm_order)::BIGINT AS first_order
FROM entries e JOIN (SELECT site_id, loc, string_agg(sm_url, ' | ' ORDER BY sm_order) AS found_in FROM f GROUP BY site_id, loc) g ON g.site_id = e.site_id AND g.loc = e.loc GROUP BY e.site_id, e.loc""",
    "duplicate_url": f"""
WITH {ENTRIES}
SELECT site_id, loc AS url, 'DUPLICATE_URL' AS code, 'listed ' || count(*) || ' times in ' || string_agg(sm_url, ' | ' ORDER BY sm_order) AS message FROM entries GROUP BY site_id, loc HAVING count(*) > 1""",
    "sitemap_duplicates": f"""
WITH {ENTRIES}, again AS (SELECT * FROM entries UNION ALL SELECT * FROM entries WHERE page_id % 4 = 0)
SELECT site_id, sm_order, count(DISTINCT loc) AS unique_urls, count(*) - count(DISTINCT loc) AS duplicates_inside FROM again GROUP BY site_id, sm_order""",
    "first_seen_limit": f"WITH {LISTED} SELECT site_id, url FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seen) AS k FROM listed) WHERE k <= 5",
    "section_exclusion": f"""
WITH p AS (SELECT url, {on(BARE)} AS site_id FROM pages),
s AS (SELECT p.site_id, p.url, part FROM p JOIN (VALUES ('en'), ('de')) AS parts(part) ON regexp_matches(p.url, '^[a-z]+://[^/?#]*/' || part || '([/?]|$)'))
SELECT site_id, site_id || '/' || part AS section_id, '/' || part AS prefix, count(DISTINCT url) AS urls FROM s GROUP BY site_id, part""",
    "robots_parse": """
SELECT grp_no::BIGINT AS grp_no, rule_no::BIGINT AS rule_no, allow, raw, raw AS pattern FROM (VALUES (1, 2, false, '/de/'), (1, 3, true, '/de/1'), (1, 4, false, '/*.html$'), (1, 5, false, '/*?*ref='),
  (2, 8, false, '/fr/'), (2, 9, true, '/*page='), (2, 10, false, '/en/9')) AS r(grp_no, rule_no, allow, raw)""",
    "robots_agents": """
SELECT user_agent, agent, crawl_delay::DOUBLE AS crawl_delay FROM (VALUES ('Googlebot/2.1', 'googlebot', 2.5), ('Googlebot-News', 'googlebot', 2.5), ('Mozilla/5.0 (x)', '*', 0.0), ('OTHERBOT', 'otherbot', 2.5)) AS a(user_agent, agent, crawl_delay)""",
    "robots_allowed": rf"""
WITH t AS (SELECT page_id, CASE WHEN path = '' OR starts_with(path, '?') THEN '/' || path ELSE path END AS target FROM (SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]*(.*)$', 1) AS path FROM pages)),
hits AS ({_VERDICT}),
best AS (SELECT page_id, agent, arg_max(allow, size * 2 + allow::INT) AS allow, arg_max(rule, size * 2 + allow::INT) AS rule FROM hits GROUP BY page_id, agent)
SELECT t.page_id, a.agent, t.target, coalesce(b.allow, true) AS allowed, coalesce(b.rule, '') AS rule
FROM t CROSS JOIN (VALUES ('*'), ('googlebot')) AS a(agent) LEFT JOIN best b ON b.page_id = t.page_id AND b.agent = a.agent""",
    "redirect_chains": """
WITH RECURSIVE total AS (SELECT count(*) AS n FROM pages),
step AS (
  SELECT page_id AS start, page_id AS at, (page_id * 7 + 1) % n AS next, [page_id] AS seen, 1 AS hop, NULL::VARCHAR AS outcome, 0 AS chain FROM pages, total WHERE page_id % 4 <> 0
  UNION ALL
  SELECT start, next, (next * 7 + 1) % n, list_append(seen, next), hop + 1, outcome, chain FROM (
    SELECT s.*, n, CASE WHEN list_contains(seen, next) THEN 'loop' WHEN hop > 4 THEN 'limit' WHEN next % 4 = 0 THEN 'answer' END AS met FROM step s, total) WHERE met IS NULL),
ended AS (SELECT *, CASE WHEN list_contains(seen, next) THEN 'loop' WHEN hop > 4 THEN 'limit' WHEN next % 4 = 0 THEN 'answer' END AS met FROM step)
SELECT 'https://example.com/' || start AS url, met AS end, 'https://example.com/' || next AS last, hop::BIGINT AS hop,
  CASE WHEN met = 'answer' THEN CASE WHEN next % 8 = 0 THEN 200 ELSE 404 END ELSE 0 END::BIGINT AS final_status, (CASE WHEN met = 'answer' THEN hop ELSE hop - 1 END)::BIGINT AS hops
FROM ended WHERE met IS NOT NULL""".replace("met AS end,", 'met AS "end",'),
    "status_classes": f"""
WITH {ANSWERS}
SELECT site_id, CASE WHEN NOT crawled THEN 'not crawled' WHEN status = 0 THEN 'no response' ELSE (status // 100) || 'xx' END AS status_class,
  CASE WHEN NOT crawled THEN '-' WHEN status = 0 THEN '000' ELSE status::VARCHAR END AS status_key, {STATUS_TEXT} AS status_text, count(*) AS n FROM answers GROUP BY ALL""",
    "url_checks_crawl": f"WITH {FOUND} SELECT site_id, url, code, severity, message FROM found",
    "response_bounds": """
SELECT page_id, least(size, 1600)::BIGINT AS size, size > 1600 AS truncated, least(size, 100)::BIGINT AS kept, md5(encode(html)[1:100]) AS head_md5 FROM (SELECT *, strlen(html) AS size FROM pages)""",
    "soft_404_titles": """
SELECT doc_id, regexp_matches(lower(title), '(^|[^0-9])404([^0-9]|$)|not found|page not found|error 404|nicht gefunden|introuvable|no encontrad|non trovat|não encontrad|niet gevonden|nie znaleziono|nu a fost g[aă]sit|не найден') AS soft
FROM (SELECT doc_id, string_split(text, chr(10))[1] || ['', ' 404', ' 4040', ' Page Not Found', ' nu a fost gasit', ' introuvable'][doc_id % 6 + 1] AS title FROM documents)""",
    "noindex_values": """
SELECT page_id, ['noindex', 'NONE', 'index, follow', 'googlebot: noindex', 'otherbot: noindex', 'otherbot: noindex, googlebot: noarchive', 'unavailable_after: 25 Jun 2010 15:00:00 PST, noindex', 'max-snippet: 20, noindex', ''][page_id % 9 + 1] AS value,
  page_id % 9 IN (0, 1, 3, 6, 7) AS noindex FROM pages""",
    "html_sniff": r"""
WITH x AS (
  SELECT page_id, page_id % 6 AS kind, lower(left(CASE page_id % 7 WHEN 0 THEN substr(html, 200, 4000) WHEN 1 THEN '<bodyguard>' || substr(html, 40, 400) ELSE html END, 2048)) AS head FROM pages)
SELECT page_id, CASE kind WHEN 1 THEN true WHEN 2 THEN false ELSE
  list_bool_or(list_transform(['<!doctype html', '<html', '<head', '<body'], lambda m: instr(head, m) > 0 AND substr(head, instr(head, m) + len(m), 1) IN ('', '>', ' ', chr(10), chr(9), chr(13)))) END AS html FROM x""",
    "canonical_resolve": rf"""
SELECT page_id, canonical, page_id % 4 = 2 OR (page_id % 4 = 3 AND {on(QUERY)} = 'q=1') AS same
FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/c/' || page_id WHEN 1 THEN regexp_extract(url, '^[a-z]+:', 0) || '//other.example.org/x'
  WHEN 2 THEN url || '#frag' ELSE regexp_replace(url, '[?#].*$', '') || '?q=1' END AS canonical FROM pages)""",
    "lastmod_mismatch": """
SELECT o_orderkey, 'LASTMOD_MISMATCH' AS code, '<lastmod> ' || strftime(o_orderdate::DATE + (o_orderkey % 4)::INT, '%Y-%m-%d') || ', Last-Modified ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS message
FROM orders WHERE o_orderkey % 5 <> 0 AND abs(epoch((o_orderdate::DATE + (o_orderkey % 4)::INT)::TIMESTAMP) - epoch(date_trunc('second', o_orderdate))) > 86400""",
    "retry_after": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 100)::DOUBLE WHEN 2 THEN greatest(0.0, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-06-01 12:00:00')) ELSE -1.0 END AS seconds FROM events""",
    "sitemap_parse": """
SELECT page_id // 50 AS file_no, 'urlset' AS kind, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS entry_pos, url AS loc, page_id % 3 = 0 AS blanks, '2024-01-0' || (page_id % 9 + 1) AS lastmod FROM pages""",
    "document_checks_of_pages": """
SELECT page_id, 'SITEMAP_NOT_SITEMAP' AS code, 'an HTML page instead of a sitemap' AS message FROM pages""",
    "tree_walk": """
WITH RECURSIVE t AS (
  SELECT 0::BIGINT AS id, '' AS parent, 0 AS depth, '0000000000' AS path
  UNION ALL SELECT p.page_id, t.id::VARCHAR, t.depth + 1, t.path || '/' || lpad(p.page_id::VARCHAR, 10, '0')
  FROM t JOIN pages p ON p.page_id BETWEEN t.id * 3 + 1 AND t.id * 3 + 3 WHERE t.depth < 5)
SELECT row_number() OVER (ORDER BY path) - 1 AS sm_order, id::VARCHAR AS url, parent, depth::BIGINT AS depth,
  CASE WHEN depth = 5 AND EXISTS (SELECT 1 FROM pages q WHERE q.page_id BETWEEN t.id * 3 + 1 AND t.id * 3 + 3) THEN 'too-deep' ELSE 'read' END AS visit FROM t""",
    "issue_counts": f"WITH {FOUND} SELECT site_id, code, count(*) AS n FROM found GROUP BY site_id, code",
    "severity_totals": f"WITH {FOUND} SELECT severity, count(*) AS n FROM found GROUP BY severity",
    "code_summary": f"WITH {FOUND}, {TITLES} SELECT severity, f.code, title, count(*) AS n FROM found f JOIN titles t ON t.code = f.code GROUP BY ALL",
    "topk_codes": f"WITH {FOUND} SELECT severity, code, n FROM (SELECT severity, rank, code, count(*) AS n FROM found GROUP BY ALL) ORDER BY rank DESC, n DESC, code LIMIT 3",
    "max_severity_per_url": f"WITH {FOUND} SELECT site_id, url, arg_max(severity, rank) AS max_severity FROM found GROUP BY site_id, url",
    "site_counts": f"WITH {ANSWERS} SELECT site_id, count(*) AS urls, count(*) FILTER (crawled) AS crawled, count(*) FILTER (occurrences > 1) AS duplicates FROM answers GROUP BY site_id",
    "sitemap_status_counts": f"""
WITH {HELD}, c AS (SELECT site_id, sm_order, CASE WHEN status = 0 THEN '000' ELSE status::VARCHAR END AS k, count(*) AS n FROM held WHERE crawled GROUP BY ALL)
SELECT site_id, sm_order, string_agg(k || ':' || n, ' ' ORDER BY k) AS statuses FROM c GROUP BY site_id, sm_order""",
    "sitemap_issue_counts": f"WITH {HELD} SELECT h.site_id, sm_order, code, count(DISTINCT h.url) AS n FROM held h JOIN found f ON f.site_id = h.site_id AND f.url = h.url GROUP BY ALL",
    "issue_texts": f"""
WITH {FOUND}
SELECT site_id, url AS target, string_agg(code, '; ' ORDER BY stage) AS issues, string_agg(code || ': ' || message, '; ' ORDER BY stage) AS details FROM found GROUP BY site_id, url""",
    "url_table_page": f"WITH {ANSWERS} SELECT page_id, url, size_bytes FROM answers ORDER BY size_bytes DESC, page_id LIMIT 100 OFFSET 200",
    "junit_matrix": f"""
WITH {FOUND}, s AS (SELECT DISTINCT site_id FROM answers),
c AS (SELECT unnest([{", ".join(f"'{d.code}'" for d in CATALOGUE)}]) AS code)
SELECT s.site_id, c.code, count(f.url) AS n FROM s CROSS JOIN c LEFT JOIN found f ON f.site_id = s.site_id AND f.code = c.code GROUP BY ALL""",
    "csv_sanitize": r"""
SELECT doc_id, md5(CASE WHEN left(cell, 1) IN ('=', '+', '@', chr(9), chr(13)) OR (left(cell, 1) = '-' AND len(cell) > 1 AND substr(cell, 2, 1) NOT IN (' ', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9')) THEN '''' || cell ELSE cell END) AS cell_md5
FROM (SELECT doc_id, ['', '=', '+', '@', '-', '- ', '-5', chr(9)][doc_id % 8 + 1] || coalesce(text, '') AS cell FROM documents)""",
    "text_clean": r"SELECT page_id, md5(trim(regexp_replace(html, '[\x00-\x20\x7F\x{A0}]+', ' ', 'g'))) AS clean_md5 FROM pages",
    "shown_values": """
SELECT event_id, floor(value * 1000 + 0.5) / 1000.0 AS rounded, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS duration
FROM (SELECT event_id, value, floor(value + 0.5)::BIGINT AS s FROM events)""",
    "latency_rollup": """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(avg(value) * 1000 + 0.5) / 1000.0 AS mean, max(value) AS longest, count(*) FILTER (value > 3) AS slow FROM events GROUP BY ALL""",
    "catalogue_groups": "SELECT grp, severity, n::BIGINT AS n FROM (VALUES "
    + ", ".join(
        f"('{g}', '{s}', {n})"
        for g, s, n in (
            ("site", "error", 2), ("site", "warning", 1), ("site", "notice", 1), ("robots", "error", 2), ("robots", "warning", 4), ("robots", "notice", 1), ("protocol", "error", 12), ("protocol", "warning", 14), ("protocol", "notice", 3),
            ("extensions", "error", 2), ("extensions", "warning", 5), ("extensions", "notice", 1), ("hreflang", "error", 1), ("hreflang", "warning", 3), ("hreflang", "notice", 1), ("status", "error", 2), ("status", "notice", 1),
            ("redirects", "error", 3), ("redirects", "warning", 2), ("soft_404", "error", 1), ("noindex", "error", 1), ("robots_blocked", "error", 1), ("canonical", "warning", 2), ("url_variants", "warning", 5), ("url_variants", "notice", 2),
            ("duplicates", "warning", 2), ("lastmod_mismatch", "warning", 1), ("performance", "warning", 2), ("content_type", "notice", 1),
        )
    )
    + ") AS c(grp, severity, n)",
}

# The whole plan over the captured pages: sites are whole hosts, a host's place in a rule is the length of its name.

_VISIBLE = r"""
plain AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(HTML, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '<[a-zA-Z/!][^>]*$', '') AS html FROM pages),
split AS (
  SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)</head>(.*)$', 1), '</[^>]*>|<(p|div|br|li|tr|td|th|h[2-6]|section|article|header|footer|nav|main|ul|ol|table)([ /][^>]*)?>', ' ', 'g'), '<[a-zA-Z!][^>]*>', '', 'g') AS body FROM plain),
signals AS (SELECT page_id, """ + ", ".join(
    rf"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace({c}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;?', '&', 'g'), '[\x00-\x20\x7F\x{{A0}}]+', ' ', 'g')) AS {c}""" for c in ("title", "h1", "body")
) + " FROM split)"
SIGNALS = _VISIBLE.replace("HTML", "html")
SITEMAPS_OF = f"""
h AS (SELECT page_id, url, {on(HOST)} AS site_id, page_id // 50 AS file_no FROM pages),
hosts AS (SELECT DISTINCT site_id, len(site_id) AS size, 'https://' || site_id AS base FROM h)"""
NAMES = f"SELECT site_id, url, page_id, regexp_split_to_array({on(QUERY)}, '[&;]') AS parts FROM h"
_AUDITED = (
    SIGNALS
    + ","
    + SITEMAPS_OF
    + f""",
facts AS (
  SELECT h.*, [200, 200, 301, 404, 0][page_id % 5 + 1] AS status, {key("url")} AS key, {key("url", True)} AS fold, {on(STYLE)} AS style, {on(PATH)} AS path,
    list_filter(list_transform(list_filter(regexp_split_to_array({on(QUERY)}, '[&;]'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)), lambda x: true) AS names FROM h),
counted AS (
  SELECT f.*, s.title, s.h1, strlen(s.body) AS bytes, len(s.body) AS text_length, count(*) OVER (PARTITION BY site_id, key) AS same_key, count(*) OVER (PARTITION BY site_id, fold) AS same_fold,
    count(*) FILTER (style = 'slash') OVER (PARTITION BY site_id) AS slashes, count(*) FILTER (style = 'noslash') OVER (PARTITION BY site_id) AS plains,
    len(list_filter(names, lambda x: regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid)$'))) AS tracks FROM facts f JOIN signals s USING (page_id)),
told AS (
  SELECT site_id, 'url' AS scope, url AS target, code, place FROM (
    SELECT *, unnest([
      CASE WHEN contains(url, '#') THEN {{code: 'LOC_FRAGMENT', place: 10}} END,
      CASE WHEN page_id % 9 = 8 THEN {{code: 'LASTMOD_INVALID', place: 11}} END,
      CASE WHEN page_id % 10 = 0 THEN {{code: 'DUPLICATE_URL', place: 20}} END,
      CASE WHEN starts_with(url, 'http://') THEN {{code: 'HTTP_URL', place: 40}} END,
      CASE WHEN (style = 'slash' AND plains > slashes) OR (style = 'noslash' AND slashes > plains) THEN {{code: 'TRAILING_SLASH', place: 41}} END,
      CASE WHEN tracks > 0 THEN {{code: 'TRACKING_PARAMS', place: 42}} WHEN len(names) > 0 THEN {{code: 'QUERY_PARAMS', place: 42}} END,
      CASE WHEN same_key > 1 THEN {{code: 'NEAR_DUPLICATE', place: 43}} WHEN same_fold > 1 THEN {{code: 'CASE_VARIANT', place: 43}} END,
      CASE WHEN starts_with(path, '/de/') THEN {{code: 'ROBOTS_BLOCKED', place: 50}} END,
      CASE status WHEN 0 THEN {{code: 'URL_NO_RESPONSE', place: 60}} WHEN 404 THEN {{code: 'URL_HTTP_ERROR', place: 60}} WHEN 301 THEN {{code: 'URL_REDIRECT', place: 60}} END,
      CASE WHEN status = 200 AND (text_length < 100 OR regexp_matches(lower(title || ' ' || h1), '(^|[^0-9])404([^0-9]|$)|not found|page not found|error 404|nicht gefunden|introuvable|no encontrad|non trovat|não encontrad|niet gevonden|nie znaleziono|nu a fost g[aă]sit|не найден')) THEN {{code: 'SOFT_404', place: 80}} END
    ], recursive := false) AS found FROM counted), LATERAL (SELECT found.code AS code, found.place AS place) WHERE found IS NOT NULL
  UNION ALL SELECT site_id, 'site', base, 'SITE_HTTP_ERROR', 0 FROM hosts WHERE size % 2 = 1
  UNION ALL SELECT site_id, 'site', base, unnest(['ROBOTS_NO_SITEMAP', 'SITEMAP_FALLBACK_ONLY']), 0 FROM hosts WHERE size % 3 = 1
  UNION ALL SELECT site_id, 'site', base, 'ROBOTS_SITEMAP_INVALID', 0 FROM hosts WHERE size % 3 = 2
  UNION ALL SELECT site_id, 'sitemap', base || '/gone.xml', 'SITEMAP_HTTP_ERROR', 0 FROM hosts WHERE size % 3 = 2
  UNION ALL SELECT site_id, 'sitemap', base || '/sitemap.xml', 'SITEMAP_INDEX_CYCLE', 0 FROM hosts
  UNION ALL SELECT DISTINCT site_id, 'sitemap', file_no::VARCHAR, 'SITEMAP_DUPLICATE_ENTRIES', 0 FROM h WHERE page_id % 10 = 0),
severities(code, severity, rank) AS (VALUES """
    + ", ".join(f"('{d.code}', '{d.severity}', {('notice', 'warning', 'error').index(d.severity) + 1})" for d in CATALOGUE)
    + "),\nissues AS (SELECT t.*, severity, rank FROM told t JOIN severities s ON s.code = t.code)"
)

ORACLES |= {
    "page_analyze": f"WITH {SIGNALS} SELECT page_id, title, h1, len(body) AS text_length, 0::BIGINT AS n_robots, 0::BIGINT AS n_canonicals FROM signals",
    "audit_issues": f"WITH {_AUDITED} SELECT scope, code, severity, count(*) AS n FROM issues GROUP BY ALL",
    "audit_urls": f"""
WITH {_AUDITED},
own AS (SELECT site_id, target, string_agg(code, '; ' ORDER BY place) AS issues, arg_max(severity, rank) AS worst FROM issues WHERE scope = 'url' GROUP BY site_id, target)
SELECT c.site_id, url, CASE status WHEN 0 THEN '000' ELSE status::VARCHAR END AS status, CASE status WHEN 301 THEN 'https://' || c.site_id || '/moved' ELSE '-' END AS redirect_to, CASE status WHEN 301 THEN '200' ELSE '-' END AS final_status,
  CASE status WHEN 0 THEN 'timeout' ELSE '-' END AS error, CASE WHEN page_id % 10 = 0 THEN '2' ELSE '1' END AS occurrences, 'https://' || c.site_id || '/sitemap-' || file_no || '.xml' AS found_in,
  CASE status WHEN 200 THEN title ELSE '' END AS title, CASE status WHEN 200 THEN text_length ELSE 0 END::VARCHAR AS text_length, coalesce(worst, '-') AS max_severity, coalesce(own.issues, '-') AS issues
FROM counted c LEFT JOIN own ON own.site_id = c.site_id AND own.target = c.url""",
    "audit_sitemaps": f"""
WITH {SITEMAPS_OF},
files AS (SELECT site_id, file_no, count(*) AS urls, count(*) FILTER (page_id % 10 = 0) AS twice, row_number() OVER (PARTITION BY site_id ORDER BY file_no) AS k FROM h GROUP BY site_id, file_no),
many AS (SELECT site_id, max(k) AS k FROM files GROUP BY site_id),
maps AS (
  SELECT s.site_id, base || '/sitemap.xml' AS url, '' AS parent, 'index' AS kind, 0::BIGINT AS sm_order, 0 AS depth, 200 AS status, m.k + 1 AS entries, 0 AS unique_urls, 0 AS duplicates_inside FROM hosts s JOIN many m ON m.site_id = s.site_id
  UNION ALL SELECT s.site_id, base || '/sitemap-' || file_no || '.xml', base || '/sitemap.xml', 'urlset', k, 1, 200, urls + twice, urls, twice FROM hosts s JOIN files f ON f.site_id = s.site_id
  UNION ALL SELECT s.site_id, base || '/sitemap.xml', base || '/sitemap.xml', 'cycle', m.k + 1, 1, 0, 0, 0, 0 FROM hosts s JOIN many m ON m.site_id = s.site_id
  UNION ALL SELECT s.site_id, base || '/gone.xml', '', 'not-sitemap', m.k + 2, 0, 404, 0, 0, 0 FROM hosts s JOIN many m ON m.site_id = s.site_id WHERE size % 3 = 2)
SELECT site_id, url, parent, kind, len(site_id) % 3 <> 1 AS in_robots, sm_order, depth::BIGINT AS depth, status::BIGINT AS status, entries::BIGINT AS entries, unique_urls::BIGINT AS unique_urls, duplicates_inside::BIGINT AS duplicates_inside FROM maps""",
    "audit_sites": f"""
WITH {_AUDITED},
u AS (SELECT site_id, count(*) AS urls, count(DISTINCT file_no) AS files, count(*) FILTER (page_id % 10 = 0) AS duplicates, count(*) FILTER (status = 200) AS good, count(*) FILTER (status = 301) AS moved, count(*) FILTER (status = 404) AS gone, count(*) FILTER (status = 0) AS silent FROM counted GROUP BY site_id),
i AS (SELECT site_id, count(*) FILTER (rank = 3) AS errors, count(*) FILTER (rank = 2) AS warnings, count(*) FILTER (rank = 1) AS notices FROM issues GROUP BY site_id)
SELECT s.site_id, CASE WHEN size % 2 = 0 THEN '200' ELSE '503' END AS home_status, 'YES' AS robots, '200' AS robots_http, base || '/sitemap.xml' AS sitemap, CASE WHEN size % 3 = 1 THEN 'fallback' ELSE 'robots' END AS sitemap_source,
  (files + 1)::VARCHAR AS sitemap_files, urls::VARCHAR AS urls, urls::VARCHAR AS crawled, good::VARCHAR AS "2xx", moved::VARCHAR AS "3xx", gone::VARCHAR AS "4xx", silent::VARCHAR AS "000", duplicates::VARCHAR AS duplicates,
  errors::VARCHAR AS errors, warnings::VARCHAR AS warnings, notices::VARCHAR AS notices FROM hosts s JOIN u ON u.site_id = s.site_id JOIN i ON i.site_id = s.site_id""",
    "page_signals": f"""
WITH {_VISIBLE.replace("HTML", "html")}
SELECT s.page_id, title, len(body)::BIGINT AS text_length, array_to_string(list_filter([CASE WHEN s.page_id % 3 = 0 THEN 'noindex, follow' END, CASE WHEN s.page_id % 4 = 0 THEN 'none' END], lambda x: x IS NOT NULL), ' | ') AS robots,
  s.page_id % 3 = 0 OR s.page_id % 4 = 0 AS noindex, array_to_string(list_filter([CASE WHEN s.page_id % 5 < 2 THEN url END, CASE WHEN s.page_id % 5 = 1 THEN '/other' END], lambda x: x IS NOT NULL), ' | ') AS canonicals
FROM signals s JOIN pages p ON p.page_id = s.page_id""",
    "sitemap_extensions": """
SELECT page_id, 'urlset' AS kind, 1::BIGINT AS news_count, 'daily' AS changefreq, '0.5' AS priority, page_id % 3 AS images, 'A & B' AS video_title, page_id::VARCHAR AS video_duration, 'Paper <' || page_id || '>' AS paper, 'en' AS paper_language,
  'alternate' AS rel, 'de' AS hreflang, 'https://example.com/de/' || page_id AS href FROM pages""",
    "sitemap_lists": """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not-sitemap' ELSE 'text' END AS kind, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS entries, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS first FROM pages""",
    "sitemap_gzip": """
SELECT page_id, true AS gzip, page_id % 4 = 1 AS torn, CASE WHEN page_id % 4 = 2 THEN 'ISO-8859-1' ELSE '' END AS encoding, page_id % 4 = 3 AS broken, true AS whole, CASE WHEN page_id % 4 = 1 THEN -1 ELSE 1 END::BIGINT AS entries FROM pages""",
    "run_totals": f"WITH {ANSWERS} SELECT site_id, CASE WHEN status = 0 THEN '000' ELSE status::VARCHAR END AS status_key, count(*) AS n, 'error' AS max_severity FROM answers WHERE crawled GROUP BY ALL",
    "junit_lines": f"""
WITH {FOUND},
placed AS (SELECT f.*, row_number() OVER (PARTITION BY f.site_id, code ORDER BY page_id, f.url, stage) AS k FROM found f JOIN answers a ON a.site_id = f.site_id AND a.url = f.url)
SELECT site_id, code, count(*) AS n, least(count(*), 200) AS shown, md5(string_agg(url || ': ' || message, chr(10) ORDER BY k) FILTER (k <= 200)) AS lines_md5 FROM placed GROUP BY site_id, code""",
    "url_filters": f"""
WITH {FOUND},
a AS (SELECT a.site_id, a.url, crawled, status, max(rank) AS worst, bool_or(code = 'SLOW_RESPONSE') AS slow FROM answers a LEFT JOIN found f ON f.site_id = a.site_id AND f.url = a.url GROUP BY ALL)
SELECT 'severity' AS filter, site_id, url FROM a WHERE worst = 3
UNION ALL SELECT 'status', site_id, url FROM a WHERE crawled AND status = 503
UNION ALL SELECT 'code', site_id, url FROM a WHERE slow
UNION ALL SELECT 'words', site_id, url FROM a WHERE status = 301
UNION ALL SELECT 'all', site_id, url FROM a WHERE worst >= 2 AND crawled AND status = 200 AND contains(lower(url), '/en/')""",
    "robots_spellings": "SELECT page_id::VARCHAR AS site_id, '*' AS agent, 1.5::DOUBLE AS crawl_delay, '/p' || page_id AS raw, 'https://example.com/' || page_id AS sitemap FROM pages",
    "config_values": """
SELECT * FROM (VALUES ('duration', '1h30m', 5400.0::DOUBLE), ('duration', '1.5s', 1.5), ('duration', '90', 90.0), ('duration', '250ms', 0.25), ('duration', '', 0.0), ('duration', '-1s', NULL), ('duration', 'soon', NULL),
  ('size', '5MB', 5000000.0), ('size', '512KiB', 524288.0), ('size', '10', 10.0), ('size', 'x', NULL)) AS v(kind, value, number)""",
}
