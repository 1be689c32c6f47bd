"""The registered queries once more, as SQL for DuckDB over the same tables.

Written apart from the DataFrame code: distinct counts are ``count(DISTINCT)``,
ranks are plain windows, and nothing is shared but the definition of the log.
"""

from __future__ import annotations

_LOG = """
WITH page_count AS (SELECT max(page_id) + 1 AS n FROM pages),
access_log AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'b.example.org' ELSE 'a.example.com' END AS domain,
         e.event_id, CAST(ts AS DATE) + CASE WHEN day(ts) <= 20 THEN -10 ELSE 11 END AS dt,
         CASE WHEN event_id % 59 = 0 THEN '2024-03-15'
              ELSE strftime(CAST(ts AS DATE) + CASE WHEN day(ts) <= 20 THEN -10 ELSE 11 END,
                            '%Y-%m-%d') END AS date,
         CASE WHEN event_id % 53 = 0 THEN '25' ELSE substring(CAST(ts AS VARCHAR), 12, 2) END ||
           substring(CAST(ts AS VARCHAR), 14, 6) AS time,
         CASE WHEN event_id % 97 = 0 THEN NULL
              ELSE '10.0.0.' || CAST(user_id AS VARCHAR) END AS c_ip,
         CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS cs_method,
         regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) ||
           CASE p.page_id % 8 WHEN 1 THEN '.css' WHEN 2 THEN '.MJS' WHEN 3 THEN '.png'
                WHEN 4 THEN '.woff2' WHEN 5 THEN '.json' WHEN 6 THEN '.d/index'
                ELSE '' END AS cs_uri_stem,
         CASE WHEN event_type = 'error' THEN '404' WHEN event_id % 5 = 0 THEN '304'
              ELSE '200' END AS sc_status,
         CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN url
              WHEN 4 THEN 'https://A.Example.com/x' WHEN 5 THEN 'android-app://com.app'
              ELSE 'https://search.example.net?q=1' END AS "cs_Referer",
         CASE user_id % 16 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
              WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)'
              WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'Googlebot-Image/1.0'
              WHEN 5 THEN 'DuckDuckBot/1.1 (like bingbot)' WHEN 6 THEN 'AhrefsBot/7.0'
              WHEN 7 THEN 'SemrushBot/7' WHEN 8 THEN 'Mozilla/5.0 (compatible; YandexBot/3.0)'
              WHEN 9 THEN 'Applebot/0.1' WHEN 10 THEN 'UnknownBot/1.0'
              ELSE 'Mozilla/5.0' END AS "cs_User_Agent"
  FROM events e CROSS JOIN page_count LEFT JOIN pages p ON p.page_id = e.event_id % n
),
-- the extensions are fixed values, as in schema.py
requests AS (
  SELECT domain, dt, strftime(dt, '%Y-%m') AS month, CAST(year(dt) AS INTEGER) AS year, time,
         coalesce(c_ip, '') AS c_ip,
         coalesce(cs_uri_stem, '') AS path,
         coalesce("cs_Referer", '') AS referer,
         CASE WHEN contains("cs_User_Agent", 'Googlebot-Image') THEN 'Google Images'
              WHEN contains("cs_User_Agent", 'Googlebot') THEN 'Google'
              WHEN contains("cs_User_Agent", 'DuckDuckBot') THEN 'DuckDuckGo'
              WHEN contains("cs_User_Agent", 'bingbot') THEN 'Bing'
              WHEN contains("cs_User_Agent", 'AhrefsBot') THEN 'Ahrefs'
              WHEN contains("cs_User_Agent", 'SemrushBot') THEN 'Semrush'
              WHEN contains("cs_User_Agent", 'YandexBot') THEN 'Yandex'
              WHEN contains("cs_User_Agent", 'Applebot') THEN 'Apple' END AS bot_name,
         coalesce(contains("cs_User_Agent", 'Googlebot'), false) AS crawler,
         cs_method = 'GET' AND sc_status IN ('200', '304') AS is_hit,
         CASE WHEN regexp_matches(substring(time, 1, 2), '^([0-9][0-9]|[+][0-9])$')
              THEN CAST(substring(time, 1, 2) AS INTEGER) ELSE 0 END AS hour,
         CASE lower(regexp_extract(coalesce(cs_uri_stem, ''), '[.]([^.]*)$', 1))
              WHEN 'css' THEN 'css' WHEN 'js' THEN 'js' WHEN 'mjs' THEN 'js'
              WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image'
              WHEN 'gif' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'svg' THEN 'image'
              WHEN 'ico' THEN 'image' WHEN 'avif' THEN 'image' WHEN 'bmp' THEN 'image'
              WHEN 'ttf' THEN 'font' WHEN 'woff' THEN 'font' WHEN 'woff2' THEN 'font'
              WHEN 'eot' THEN 'font' WHEN 'otf' THEN 'font'
              WHEN 'xml' THEN 'data' WHEN 'json' THEN 'data' WHEN 'rss' THEN 'data'
              WHEN 'atom' THEN 'data' WHEN 'txt' THEN 'data' ELSE 'page' END AS category
  FROM access_log WHERE date = strftime(dt, '%Y-%m-%d')
),
hits AS (SELECT * FROM requests WHERE is_hit),
sites AS (SELECT unnest(['a.example.com', 'b.example.org']) AS domain),
bounds AS (
  SELECT min(dt) AS first_dt, max(dt) AS last_dt,
         CAST(date_trunc('month', min(dt)) AS DATE) AS first_day, last_day(max(dt)) AS last_day
  FROM access_log
),
days AS (
  SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS dt
  FROM bounds
),
site_days AS (
  SELECT domain, dt, strftime(dt, '%Y-%m') AS month, CAST(year(dt) AS INTEGER) AS year
  FROM sites CROSS JOIN days
)"""

_TRAFFIC = """,
counted AS (
  SELECT domain, {key}, count(*) AS hits, count(DISTINCT c_ip) AS visitors,
         count(*) FILTER (bot_name IS NOT NULL) AS bot_hits,
         count(DISTINCT c_ip) FILTER (bot_name IS NOT NULL) AS bot_visitors
  FROM hits GROUP BY ALL
),
traffic AS (
  SELECT domain, {key}, coalesce(hits, 0) AS hits, coalesce(visitors, 0) AS visitors,
         coalesce(bot_hits, 0) AS bot_hits, coalesce(bot_visitors, 0) AS bot_visitors
  FROM (SELECT DISTINCT domain, {key} FROM site_days) LEFT JOIN counted USING (domain, {key})
)"""

_PAGE_DAYS = """,
page_days AS (
  SELECT domain, dt, month, year, category, path, count(*) AS hits,
         count(DISTINCT c_ip) AS visitors,
         count(*) FILTER (bot_name IS NOT NULL) AS bot_hits
  FROM hits GROUP BY ALL
)"""

_PAGES = (
    _PAGE_DAYS
    + """,
page_totals AS (
  SELECT domain, {key}, category, path, CAST(sum(hits) AS BIGINT) AS hits,
         CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(bot_hits) AS BIGINT) AS bot_hits
  FROM page_days GROUP BY ALL
)"""
)

_BOTS = """,
bots AS (
  SELECT domain, {key}, bot_name, count(*) AS hits, max(dt) AS last_crawl
  FROM requests WHERE bot_name IS NOT NULL GROUP BY ALL
)"""

_CRAWLED = """,
crawled AS (SELECT domain, {key}, path, count(*) AS hits FROM hits WHERE crawler GROUP BY ALL)"""

_REFERERS = """,
referers AS (
  SELECT domain, {key}, referer, count(*) AS hits
  FROM hits
  WHERE regexp_matches(referer, '^https?://')
    AND lower(regexp_extract(referer, '^https?://([^/]*)', 1)) <> lower(domain)
  GROUP BY ALL
)"""

_GAPS = """,
gaps AS (
  SELECT s.domain, m.month, page_id AS pos, url AS loc
  FROM pages CROSS JOIN sites s
  JOIN (SELECT DISTINCT domain, month FROM site_days) m ON m.domain = s.domain
  WHERE NOT EXISTS (
    SELECT 1 FROM hits h
    WHERE h.crawler AND h.domain = s.domain AND h.month = m.month
      AND h.path = CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN url
                        ELSE coalesce(nullif(regexp_extract(
                          url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/') END)
)"""


def _bot_pct(total: str, bots: str) -> str:
    return (
        f"CASE WHEN {total} = 0 THEN 0 "
        f"ELSE CAST(round(least({bots}, {total}) / {total} * 100) AS BIGINT) END"
    )


def _split(total: str, bots: str, prefix: str = "") -> str:
    pct = _bot_pct(total, bots)
    return f"CAST(100 - ({pct}) AS BIGINT) AS {prefix}human_pct, CAST({pct} AS BIGINT) AS {prefix}bot_pct"


def _rank(key: str, name: str) -> str:
    return (
        f"CAST(row_number() OVER (PARTITION BY domain, {key} ORDER BY hits DESC, {name}) "
        "AS INTEGER) AS rank"
    )


def _traffic(key: str, columns: str) -> str:
    return _LOG + _TRAFFIC.format(key=key) + f" SELECT domain, {key}, {columns} FROM traffic"


def _share(key: str, series: str) -> str:
    return (
        f"{_LOG}{_TRAFFIC.format(key=key)} SELECT domain, {key}, hits, "
        f"hits / greatest(max(hits) OVER (PARTITION BY domain, {series}), 1) * 100 AS share_of_max "
        "FROM traffic"
    )


def _pages(key: str) -> str:
    return _LOG + _PAGES.format(key=key) + " SELECT * FROM page_totals"


def _content(key: str, limit: int) -> str:
    return (
        f"{_LOG}{_PAGES.format(key=key)} SELECT domain, {key}, rank, path, hits, visitors, "
        f"{_split('hits', 'bot_hits')} FROM (SELECT *, {_rank(key, 'path')} FROM page_totals "
        f"WHERE category = 'page') WHERE rank <= {limit}"
    )


def _assets(key: str) -> str:
    return (
        f"{_LOG}{_PAGES.format(key=key)} SELECT domain, {key}, category, path, hits, visitors, "
        f"{_split('hits', 'bot_hits')} FROM page_totals WHERE category <> 'page'"
    )


def _top(ctes: str, table: str, key: str, name: str, limit: int) -> str:
    return (
        f"{_LOG}{ctes.format(key=key)} SELECT domain, {key}, rank, {name}, hits "
        f"FROM (SELECT *, {_rank(key, name)} FROM {table}) WHERE rank <= {limit}"
    )


def _kpis(key: str) -> str:
    return (
        f"{_LOG}{_TRAFFIC.format(key=key)}{_BOTS.format(key=key)}, "
        f"active AS (SELECT domain, {key}, count(*) AS n FROM bots GROUP BY ALL) "
        f"SELECT domain, {key}, hits, {_split('hits', 'bot_hits', 'hits_')}, visitors, "
        f"{_split('visitors', 'bot_visitors', 'vis_')}, coalesce(n, 0) AS active_bots "
        f"FROM traffic LEFT JOIN active USING (domain, {key})"
    )


_HOURLY = """,
hour_counts AS (
  SELECT domain, dt, hour, count(*) AS hits, count(DISTINCT c_ip) AS visitors
  FROM hits WHERE hour <= 23 GROUP BY ALL
),
hours AS (
  SELECT domain, dt, h.hour, coalesce(hits, 0) AS hits, coalesce(visitors, 0) AS visitors
  FROM site_days CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour) h
  LEFT JOIN hour_counts USING (domain, dt, hour)
)"""

_NARROW = (
    " SELECT domain, dt, date, time, c_ip, cs_method, cs_uri_stem, sc_status, "
    '"cs_Referer", "cs_User_Agent" FROM access_log'
)

_DAY_PANEL = (
    _PAGE_DAYS
    + """,
panel AS (
  SELECT domain, dt, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits,
         CAST(coalesce(sum(visitors), 0) AS BIGINT) AS visitors,
         CAST(coalesce(sum(bot_hits), 0) AS BIGINT) AS bot_hits
  FROM site_days LEFT JOIN page_days USING (domain, dt) GROUP BY domain, dt
),
estimated AS (
  SELECT *, CASE WHEN hits = 0 THEN 0
                 ELSE CAST(floor(CAST(visitors AS DOUBLE) * bot_hits / hits) AS BIGINT)
            END AS est_bot_visitors
  FROM panel
) SELECT domain, dt, hits, visitors, bot_hits, est_bot_visitors, """
    + _split("hits", "bot_hits", "hits_")
    + ", "
    + _split("visitors", "est_bot_visitors", "vis_")
    + " FROM estimated"
)

# The state the maintenance queries start from: days up to a week before the
# last one are done, and the last one is "today".
_LOG_DAYS = """,
log_days AS (SELECT domain, dt, count(*) AS n FROM access_log GROUP BY ALL),
compaction_days AS (
  SELECT s.domain, d.dt, d.dt < last_dt - 7 AND n IS NOT NULL AS done, coalesce(n, 0) AS n
  FROM (SELECT domain FROM sites UNION ALL SELECT 'c.example.net') s CROSS JOIN bounds
  JOIN days d ON d.dt >= first_dt AND d.dt < last_dt
  LEFT JOIN log_days l ON l.domain = s.domain AND l.dt = d.dt
)"""


_QUALITY = """,
quality AS (
  SELECT {keys}, count(*) FILTER (NOT own) AS stray_date_rows,
         count(*) FILTER (own AND hour > 23) AS bad_hour_rows,
         count(*) FILTER (own AND c_ip IS NULL) AS null_ip_rows,
         count(*) FILTER (own AND "cs_User_Agent" IS NULL) AS null_ua_rows
  FROM (SELECT *, date = strftime(dt, '%Y-%m-%d') AS own, strftime(dt, '%Y-%m') AS month,
               coalesce(TRY_CAST(substring(time, 1, 2) AS INTEGER), 0) AS hour
        FROM access_log)
  GROUP BY ALL
)"""

# What the report job publishes for the last year of the log on the day after
# its last, with one file that is too small.
_PUBLISHED = (
    _TRAFFIC.format(key="dt").replace("counted", "day_counts").replace("traffic", "by_day")
    + _TRAFFIC.format(key="month").replace("counted", "month_counts").replace("traffic", "by_month")
    + _HOURLY
    + _QUALITY.format(keys="domain, month")
    + """,
span AS (SELECT CAST(date_trunc('year', last_dt) AS DATE) AS low, last_dt + 1 AS high,
                CAST(year(last_dt) AS INTEGER) AS this_year, last_dt FROM bounds),
daily AS (SELECT b.* FROM by_day b CROSS JOIN span WHERE dt BETWEEN low AND high),
monthly AS (SELECT b.* FROM by_month b CROSS JOIN span
            WHERE month BETWEEN strftime(low, '%Y-%m') AND strftime(high, '%Y-%m'))
SELECT 'daily_traffic' AS report, domain, strftime(dt, '%Y-%m-%d') AS period, 'hits' AS name,
       CAST(hits AS DOUBLE) AS value FROM daily
UNION ALL SELECT 'daily_traffic', domain, strftime(dt, '%Y-%m-%d'), 'visitors',
       CAST(visitors AS DOUBLE) FROM daily
UNION ALL SELECT 'daily_shares', domain, strftime(dt, '%Y-%m-%d'), 'share_of_max',
       hits / greatest(max(hits) OVER (PARTITION BY domain, strftime(dt, '%Y-%m')), 1) * 100
       FROM daily
UNION ALL SELECT 'hourly_shares', domain, strftime(dt, '%Y-%m-%d'), CAST(hour AS VARCHAR),
       hits / greatest(max(hits) OVER (PARTITION BY domain, dt), 1) * 100
       FROM hours CROSS JOIN span WHERE dt BETWEEN low AND high
UNION ALL SELECT 'month_shares', domain, month, 'share_of_max',
       hits / greatest(max(hits) OVER (PARTITION BY domain), 1) * 100 FROM monthly
UNION ALL SELECT 'years', domain, CAST(this_year AS VARCHAR), 'is_current', 1.0
       FROM sites CROSS JOIN span
UNION ALL SELECT 'data_quality', domain, month, name, CAST(value AS DOUBLE) FROM (
    SELECT domain, month, unnest(['stray_date_rows', 'bad_hour_rows', 'null_ip_rows',
                                  'null_ua_rows', 'tiny_files']) AS name,
           unnest([coalesce(stray_date_rows, 0), coalesce(bad_hour_rows, 0),
                   coalesce(null_ip_rows, 0), coalesce(null_ua_rows, 0),
                   CASE WHEN domain = 'a.example.com' AND month = strftime(last_dt, '%Y-%m')
                        THEN 1 ELSE 0 END]) AS value
    FROM monthly CROSS JOIN span LEFT JOIN quality USING (domain, month))"""
)

# Totals of the last year of the log and its months, and the visitors of its pages.
_YEAR_FIGURES = (
    _TRAFFIC.format(key="month").replace("counted", "month_counts").replace("traffic", "by_month")
    + _TRAFFIC.format(key="year").replace("counted", "year_counts").replace("traffic", "by_year")
    + _PAGES.format(key="year")
    + """,
totals AS (
  SELECT 'month_totals' AS report, domain, month AS period, hits, visitors, bot_hits, bot_visitors
  FROM by_month
  UNION ALL SELECT 'year_totals', domain, CAST(year AS VARCHAR), hits, visitors, bot_hits, bot_visitors
  FROM by_year)
SELECT report, domain, period, unnest(['hits', 'visitors', 'bot_hits', 'bot_visitors']) AS name,
       unnest([hits, visitors, bot_hits, bot_visitors]) AS value
FROM totals CROSS JOIN bounds WHERE period[1:4] = strftime(last_dt, '%Y')
UNION ALL SELECT 'year_pages', domain, CAST(p.year AS VARCHAR), path, visitors
FROM page_totals p CROSS JOIN bounds WHERE p.year = year(last_dt)"""
)

_KEY = (
    "date || chr(1) || sc_status || chr(1) || cs_method || chr(1) || coalesce(cs_uri_stem, '') "
    "|| chr(1) || time"
)


_RANGE_VISITORS = """ SELECT domain, count(DISTINCT c_ip) AS visitors,
              count(DISTINCT c_ip) FILTER (bot_name IS NOT NULL) AS bot_visitors
              FROM hits CROSS JOIN bounds
              WHERE dt BETWEEN first_dt + 5 AND last_dt - 5 GROUP BY domain"""


def oracle_sql() -> dict[str, str]:
    return {
        "access_log_narrow": _LOG + _NARROW,
        "classified_requests": _LOG
        + " SELECT domain, dt, category, bot_name, is_hit, count(*) AS n FROM requests GROUP BY ALL",
        "bot_dimension": _LOG
        + """ SELECT DISTINCT coalesce("cs_User_Agent", '') AS ua,
              CASE WHEN contains("cs_User_Agent", 'Googlebot-Image') THEN 'Google Images'
              WHEN contains("cs_User_Agent", 'Googlebot') THEN 'Google'
              WHEN contains("cs_User_Agent", 'DuckDuckBot') THEN 'DuckDuckGo'
              WHEN contains("cs_User_Agent", 'bingbot') THEN 'Bing'
              WHEN contains("cs_User_Agent", 'AhrefsBot') THEN 'Ahrefs'
              WHEN contains("cs_User_Agent", 'SemrushBot') THEN 'Semrush'
              WHEN contains("cs_User_Agent", 'YandexBot') THEN 'Yandex'
              WHEN contains("cs_User_Agent", 'Applebot') THEN 'Apple' END AS bot_name
              FROM access_log""",
        "bot_dimension_long_list": _LOG
        + """, agents AS (SELECT DISTINCT coalesce("cs_User_Agent", '') AS ua FROM access_log),
              patterns (priority, pattern, bot_name) AS (
                VALUES (0, 'Googlebot-Image', 'Google Images'), (1, 'Googlebot', 'Google'),
                       (2, 'DuckDuckBot', 'DuckDuckGo'), (3, 'bingbot', 'Bing'),
                       (4, 'AhrefsBot', 'Ahrefs'), (5, 'SemrushBot', 'Semrush'),
                       (6, 'YandexBot', 'Yandex'), (7, 'Applebot', 'Apple')
                UNION ALL
                SELECT DISTINCT 1000 + user_id, 'Bot/' || user_id || '.', 'Bot ' || user_id
                FROM events WHERE user_id IS NOT NULL)
              SELECT ua, arg_min(bot_name, priority) AS bot_name
              FROM agents LEFT JOIN patterns ON ua <> '' AND contains(ua, pattern)
              GROUP BY ua""",
        "data_quality": _LOG + _QUALITY.format(keys="domain") + " SELECT * FROM quality",
        "calendar_days": _LOG
        + """ SELECT dt, CAST(day(dt) AS INTEGER) AS day, strftime(dt, '%b') AS month_label,
              strftime(dt, '%b %-d') AS tab_label,
              CAST(isodow(dt) - 1 AS INTEGER) AS weekday_offset FROM days""",
        "daily_traffic": _traffic("dt", "hits, visitors, bot_hits, bot_visitors"),
        "site_daily_traffic": _traffic("dt", "hits, visitors")
        + " WHERE domain = 'a.example.com'",
        "daily_traffic_share": _share("dt", "date_trunc('month', dt)"),
        "hourly_traffic": _LOG + _HOURLY + " SELECT * FROM hours",
        "hourly_traffic_share": _LOG
        + _HOURLY
        + " SELECT domain, dt, hour, hits, hits / greatest(max(hits) OVER "
        "(PARTITION BY domain, dt), 1) * 100 AS share_of_max FROM hours",
        "page_stats": _pages("dt"),
        "bot_activity_daily": _LOG
        + _BOTS.format(key="dt")
        + " SELECT domain, dt, bot_name, hits FROM bots",
        "google_hits": _LOG + _CRAWLED.format(key="dt") + " SELECT * FROM crawled",
        "referers_daily": _LOG + _REFERERS.format(key="dt") + " SELECT * FROM referers",
        "day_panel": _LOG + _DAY_PANEL,
        "visitor_days": _LOG
        + " SELECT domain, dt, c_ip, bool_or(bot_name IS NOT NULL) AS is_bot FROM hits GROUP BY ALL",
        "unique_visitors_range": _LOG + _RANGE_VISITORS,
        "bitmap_visitors_range": _LOG + _RANGE_VISITORS,
        "bitmap_year_totals": _traffic("year", "hits, visitors, bot_hits, bot_visitors"),
        "month_totals": _traffic("month", "hits, visitors, bot_hits, bot_visitors"),
        "year_totals": _traffic("year", "hits, visitors, bot_hits, bot_visitors"),
        "monthly_traffic": _traffic("month", "hits, visitors"),
        "monthly_traffic_share": _share("month", "substring(month, 1, 4)"),
        "month_pages": _pages("month"),
        "year_pages": _pages("year"),
        "month_bots": _LOG + _BOTS.format(key="month") + " SELECT * FROM bots",
        "year_bots": _LOG + _BOTS.format(key="year") + " SELECT * FROM bots",
        "month_google_hits": _LOG + _CRAWLED.format(key="month") + " SELECT * FROM crawled",
        "year_google_hits": _LOG + _CRAWLED.format(key="year") + " SELECT * FROM crawled",
        "month_referers": _LOG + _REFERERS.format(key="month") + " SELECT * FROM referers",
        "year_referers": _LOG + _REFERERS.format(key="year") + " SELECT * FROM referers",
        "month_kpis": _kpis("month"),
        "year_kpis": _kpis("year"),
        "top_content_pages": _content("month", 15),
        "day_top_content_pages": _content("dt", 15),
        "year_top_content_pages": _content("year", 15),
        "static_assets": _assets("month"),
        "day_static_assets": _assets("dt"),
        "year_static_assets": _assets("year"),
        "top_bots": _top(_BOTS, "bots", "month", "bot_name", 5),
        "day_top_bots": _top(_BOTS, "bots", "dt", "bot_name", 5),
        "year_top_bots": _top(_BOTS, "bots", "year", "bot_name", 10),
        "top_referers": _top(_REFERERS, "referers", "month", "referer", 15),
        "year_top_referers": _top(_REFERERS, "referers", "year", "referer", 15),
        "sitemap_gaps": _LOG + _GAPS + " SELECT * FROM gaps",
        "sitemap_gap_summary": _LOG
        + _GAPS
        + """ SELECT domain, month, pos, loc, greatest(n - 15, 0) AS more
              FROM (SELECT *, count(*) OVER (PARTITION BY domain, month) AS n,
                           row_number() OVER (PARTITION BY domain, month ORDER BY pos) AS place
                    FROM gaps) WHERE place <= 15""",
        "sync_plan": _LOG
        + _LOG_DAYS
        + """ SELECT domain, dt, reason FROM (
                SELECT s.domain, s.dt,
                       CASE WHEN s.dt = last_dt THEN 'today' WHEN s.dt = first_dt THEN 'forced'
                            WHEN n IS NULL OR s.dt >= last_dt - 7 THEN 'new' END AS reason
                FROM site_days s CROSS JOIN bounds
                LEFT JOIN log_days l ON l.domain = s.domain AND l.dt = s.dt
                WHERE s.dt <= last_dt) WHERE reason IS NOT NULL""",
        "refreshed_log": _LOG + _NARROW,
        "refreshed_month_totals": _traffic("month", "hits, visitors, bot_hits, bot_visitors"),
        "late_rows_month_totals": _traffic("month", "hits, visitors, bot_hits, bot_visitors"),
        "interrupted_refresh_totals": _traffic("month", "hits, visitors, bot_hits, bot_visitors"),
        "compaction_plan": _LOG
        + _LOG_DAYS
        + """ SELECT domain, dt, CASE WHEN done THEN 0 ELSE n END AS rows,
              CASE WHEN done THEN 'exists' WHEN n = 0 THEN 'no_raw' ELSE 'compact' END AS action
              FROM compaction_days""",
        "compacted_log": _LOG + _NARROW,
        "crashed_compaction_log": _LOG + _NARROW,
        "compacted_day_order": _LOG
        + f""" SELECT domain, dt, count(*) AS rows, min({_KEY}) AS first_key,
               max({_KEY}) AS last_key, CAST(0 AS BIGINT) AS overlapping_files
               FROM access_log GROUP BY ALL""",
        "compaction_totals": _LOG
        + _LOG_DAYS
        + """ SELECT domain, count(*) FILTER (NOT (done OR n = 0)) AS compacted_days,
              count(*) FILTER (done OR n = 0) AS skipped_days,
              CAST(sum(CASE WHEN done THEN 0 ELSE n END) AS BIGINT) AS rows
              FROM compaction_days GROUP BY domain""",
        "published_reports": _LOG + _PUBLISHED,
        "one_day_changed_reports": _LOG + _YEAR_FIGURES,
        "sitemap_entries": "SELECT url AS loc FROM pages",
        "sitemap_problems": """SELECT kind || '.example.com' AS domain, problem,
              CASE WHEN kind = 'good' THEN n ELSE 0 END AS entries
              FROM (SELECT count(*) AS n FROM pages)
              CROSS JOIN (VALUES ('good', 'none'), ('cut', 'not_xml'), ('gone', 'no_entries'),
                                 ('bare', 'no_location'), ('blank', 'empty'), ('missing', 'missing'))
              AS kinds (kind, problem)""",
        "compaction_summary": _LOG
        + _LOG_DAYS
        + """ SELECT domain, dt, CASE WHEN done THEN 0 ELSE n END AS rows,
              done OR n = 0 AS skipped FROM compaction_days""",
        "available_years": _LOG
        + """ SELECT DISTINCT domain, year FROM (
                SELECT domain, year FROM hits
                UNION ALL
                SELECT domain, CAST(year(last_dt) + 1 AS INTEGER) FROM hits CROSS JOIN bounds)""",
    }
