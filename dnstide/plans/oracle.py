"""DuckDB SQL for the registered queries, from the ``events`` table itself rather than from log lines."""

from __future__ import annotations

from dnstide.plans.queries import COARSE, DAY_END, FINE, HEAVY, VIEW
from dnstide.sources.fixture import RECORD_SQL

#: rec: accepted records; keyed: each under both keys; named: with normalised names.
BASE = f"""
WITH ev AS (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM events),
rec AS (SELECT {RECORD_SQL.replace("{S}", "VARCHAR")} FROM ev WHERE event_id % 53 <> 0 AND event_id % 59 <> 0),
keyed AS (
  SELECT *, view || '$' || zone AS key FROM rec UNION ALL SELECT *, '*$' || zone FROM rec
),
bucketed AS (
  SELECT *, CASE WHEN rtype IN ('A', 'MX', 'AAAA', 'CNAME', 'NS', 'SOA', 'TXT', 'SPF', 'SRV', 'DNAME', 'NAPTR') THEN rtype ELSE 'OTHER' END AS rtype_l,
         CASE WHEN rcode IN ('NOERROR', 'FORMATERR', 'SERVFAIL', 'NXDOMAIN', 'NOTIMP', 'REFUSED') THEN rcode ELSE 'OTHER' END AS rcode_l,
         CASE WHEN strlen(domain) < 32 THEN rtrim(domain, '.') || '.' END AS dname, CASE WHEN strlen(client_ip) < 32 THEN client_ip || '.' END AS iname
  FROM keyed
)"""

_STAMP = "strftime({0}, '%Y%m%d%H%M%S')"


def _end(ts: str, width: str) -> str:
    return f"(time_bucket(INTERVAL '{width}', {ts}) + INTERVAL '{width}')"


_HOUR = _STAMP.format(_end("ts", "1 hour"))
#: hourly: the rows of the item tables.
HOURLY = f"""{BASE},
counted AS (
  SELECT 'domain' AS kind, key, {_HOUR} AS stamp, dname AS name, count(*) AS n FROM bucketed WHERE dname IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'ip', key, {_HOUR}, iname, count(*) FROM bucketed WHERE iname IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'rcode', key, {_HOUR}, rcode_l, count(*) FROM bucketed GROUP BY ALL
  UNION ALL SELECT 'rtype', key, {_HOUR}, rtype_l, count(*) FROM bucketed GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, key, stamp ORDER BY n DESC, name) AS r FROM counted),
hourly AS (
  SELECT kind, key AS view, stamp, CASE WHEN kind = 'ip' THEN name[:-2] ELSE name END AS item, n AS query_num FROM ranked WHERE r <= 1000 OR kind IN ('rcode', 'rtype')
)"""
DAILY = f"""{HOURLY},
summed AS (
  SELECT kind, view, {_STAMP.format(_end("strptime(stamp, '%Y%m%d%H%M%S')", "1 day"))} AS stamp, item, CAST(sum(query_num) AS BIGINT) AS query_num FROM hourly GROUP BY ALL
),
daily AS (
  SELECT kind, view, stamp, item, query_num FROM (SELECT *, row_number() OVER (PARTITION BY kind, view, stamp ORDER BY query_num DESC, item) AS r FROM summed)
  WHERE r <= 1000 OR kind IN ('rcode', 'rtype')
)"""
#: samples: five-minute rows of live keys.
SAMPLES = f"""{BASE},
hours AS (SELECT key, {_end("ts", "1 hour")} AS h, min({_end("ts", "5 minutes")}) AS m FROM keyed GROUP BY ALL),
spine AS (SELECT key, h, unnest(generate_series(m, h, INTERVAL 5 MINUTE)) AS t FROM hours),
parts AS (
  SELECT key, {_end("ts", "1 hour")} AS h, {_end("ts", "5 minutes")} AS t, count(*) AS n, count(*) FILTER (WHERE rcode = 'SERVFAIL') AS f,
         count(*) FILTER (WHERE ts >= {_end("ts", "5 minutes")} - INTERVAL 10 SECOND) AS last FROM keyed GROUP BY ALL
),
filled AS (
  SELECT key, t, coalesce(last, 0) / 10.0::DOUBLE AS qps, sum(n) OVER w AS n, sum(f) OVER w AS f FROM spine LEFT JOIN parts USING (key, h, t)
  WINDOW w AS (PARTITION BY key, h ORDER BY t)
),
samples AS (
  SELECT key, {_STAMP.format("t")} AS stamp, t, qps, CASE WHEN (n - f)::DOUBLE / n < 0.1 THEN 1.0 ELSE (n - f)::DOUBLE / n END AS success_rate FROM filled
)"""
MEANS = f"""{SAMPLES},
means AS (SELECT key, {_end("t", "30 minutes")} AS t, avg(qps) AS q, avg(success_rate) AS s FROM samples GROUP BY ALL),
half AS (
  SELECT l.key, l.stamp, coalesce(q, 0.0::DOUBLE) AS qps, coalesce(s, 1.0::DOUBLE) AS success_rate
  FROM (SELECT key, stamp, t FROM samples WHERE stamp[11:12] IN ('00', '30')) l LEFT JOIN means USING (key, t)
)"""
#: pfx: a prefix of each line's client; subnets: those inserted.
SUBNETS = f"""{BASE},
pfx AS (
  SELECT event_id AS position, rcode, client_ip || CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 43 = 0 THEN '/8x' ELSE '/' || (event_id % 35) END AS cidr,
         'net' || (event_id % 100) AS info, CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN NULL ELSE event_id % 35 END AS size,
         CASE WHEN client_ip LIKE '%:%' THEN NULL ELSE string_split(client_ip, '.')[1]::BIGINT * 16777216 + string_split(client_ip, '.')[2]::BIGINT * 65536
              + string_split(client_ip, '.')[3]::BIGINT * 256 + string_split(client_ip, '.')[4]::BIGINT END AS ip
  FROM rec
),
cidrs AS (
  SELECT position, rcode, cidr, info, CASE WHEN ip IS NOT NULL AND size BETWEEN 1 AND 32 THEN ((ip >> (32 - size)) << (32 - size))::BIGINT END AS net,
         CASE WHEN ip IS NOT NULL AND size BETWEEN 1 AND 32 THEN size::INTEGER END AS len
  FROM pfx
),
placed AS (
  SELECT *, CASE WHEN net IS NULL THEN 'FORMAT_ERROR' WHEN row_number() OVER (PARTITION BY net, len ORDER BY position) = 1 THEN 'SUCCEED' ELSE 'DUP_KEY' END AS status FROM cidrs
),
subnets AS (SELECT net, len, info FROM placed WHERE status = 'SUCCEED')"""


def _range(table: str, kind: str, span: tuple[str, str]) -> str:
    return f"SELECT item, CAST(sum(query_num) AS BIGINT) AS query_num FROM {table} WHERE kind = '{kind}' AND view = '{VIEW}' AND stamp >= '{span[0]}' AND stamp < '{span[1]}' GROUP BY item"


def _long(kind: str, n: int | None) -> str:
    cut = f" ORDER BY query_num DESC, item LIMIT {n}" if n else ""
    recent = f"SELECT item, CAST(sum(query_num) AS BIGINT) AS query_num FROM hourly WHERE kind = '{kind}' AND view = '{VIEW}' AND stamp >= (SELECT max(stamp) FROM daily WHERE kind = '{kind}') AND stamp < '{COARSE[1]}' GROUP BY item"
    both = f"(SELECT * FROM ({_range('daily', kind, COARSE)}{cut}) UNION ALL SELECT * FROM ({recent}{cut}))"
    return f"SELECT * FROM (SELECT item, CAST(sum(query_num) AS BIGINT) AS query_num, '{kind}' AS kind FROM {both} GROUP BY item ORDER BY query_num DESC, item LIMIT {n or 1000})"


def _top(name: str, n: int) -> str:
    return f"SELECT key, {name} AS name, count(*) AS count, CAST(row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, {name}) AS INTEGER) AS rank FROM bucketed WHERE {name} IS NOT NULL GROUP BY key, {name} QUALIFY rank <= {n}"


def _thin(table: str, key: str, order: str) -> str:
    return f"""SELECT * EXCLUDE (i, n, step) FROM (
  SELECT *, greatest(n // 1500, 1) AS step FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {table}))
  WHERE n <= 1500 OR (i < n - 1 AND i % step = 0 AND i // step < 1500)"""


#: five: five-minute rows of two interfaces.
_FIVE = """WITH five AS (
  SELECT 'eth' || (user_id % 2) AS ethn, strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y%m%d%H%M%S') AS stamp, avg(value) AS rx_rate, max(value) AS tx_rate FROM events GROUP BY ALL
)"""


def _cut(name: str, table: str, by: str) -> str:
    """CTEs that cut ``table(by, name, lower, over)``, whose rows without a name say what may be missing."""
    on = by.replace(" ", "").split(",")
    same = " AND ".join(f"l.{c} = r.{c}" for c in on)
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY over DESC, name) AS r FROM {table} WHERE name IS NOT NULL),
{name}_off AS (SELECT {by}, coalesce(max(over) FILTER (WHERE r = {HEAVY + 1}), 0) AS off FROM {name}_ranked GROUP BY ALL),
{name} AS (
  SELECT {", ".join(f"l.{c}" for c in on)}, name, lower, over - off AS over FROM {name}_ranked l JOIN {name}_off r ON {same} WHERE l.r <= {HEAVY}
  UNION ALL SELECT {by}, NULL, 0, off FROM {name}_off
  UNION ALL SELECT {by}, NULL, 0, over FROM {table} WHERE name IS NULL
)"""


_REASONS = """SELECT reason, count(*) AS count FROM (
  SELECT CASE WHEN event_id % 59 = 0 THEN 'zone' WHEN event_id % 53 = 0 THEN 'colon' ELSE 'accepted' END AS reason FROM events) GROUP BY reason"""
_VALUE_LINES = f"""line AS (
  SELECT event_id, strftime(ts, '%d-%b-%Y %H:%M:%S.%g') || ' client ' || client_ip || ' ' || (event_id % 60000) || ': view ' || view || CASE WHEN event_id % 53 = 0 THEN '' ELSE ':' END
         || ' ' || domain || ' IN ' || rtype || ' ' || rcode || CASE WHEN event_id % 59 = 0 THEN '' ELSE ' + NS NE NT ND  NC ' || zone END AS log
  FROM (SELECT {RECORD_SQL.replace("{S}", "VARCHAR")} FROM ev)
)"""
_LOOKUP = "rtrim({0}, '.') || '.'"
_V6 = "({0} LIKE '%:%')"

ORACLES: dict[str, str] = {
    "parse_log": f"{BASE} SELECT event_id AS position, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, client_ip, view, domain, rtype, rcode, zone FROM rec",
    "stream_follow": _REASONS,
    "history_append": f"{HOURLY} SELECT * FROM hourly WHERE stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}'",
    "latest_log": f"{BASE}, {_VALUE_LINES} SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS id, log FROM (SELECT * FROM line WHERE NOT regexp_matches(log, '127.0.0.1') ORDER BY event_id DESC LIMIT 1000)",
    "stats_reply": f"{BASE} SELECT key, '[' || string_agg('\"' || name || '\"', ',' ORDER BY rank) || ']' AS names, '[' || string_agg(count::VARCHAR, ',' ORDER BY rank) || ']' AS counts FROM ({_top('dname', 20)}) GROUP BY key",
    "report_json": f"""{SAMPLES}
SELECT 'domaintopn' AS report, key, '[' || string_agg('["' || name || '", ' || count || ']', ', ' ORDER BY rank) || ']' AS body FROM ({_top('dname', 10)}) GROUP BY key
UNION ALL SELECT 'qps', key, '[' || string_agg('["' || stamp || '", ' || qps::VARCHAR || ']', ', ' ORDER BY stamp) || ']' FROM ({_thin('samples', 'key', 'stamp')}) GROUP BY key
UNION ALL SELECT 'success_rate', key, '{{"success_rate": ' || format('{{:.6f}}', count(*) FILTER (WHERE rcode <> 'SERVFAIL') / count(*)::DOUBLE) || '}}' FROM keyed GROUP BY key""",
    "reject_lines": _REASONS,
    "view_keys": f"{BASE} SELECT event_id AS position, key FROM keyed",
    "valid_keys": f"{BASE} SELECT event_id AS position, view || '$' || domain || '.' || domain || '.' || zone AS key FROM rec WHERE strlen(view || '$' || domain || '.' || domain || '.' || zone) <= 64",
    "normalize_names": f"{BASE} SELECT domain AS raw, {_LOOKUP.format('domain')} AS name, count(*) AS count FROM rec WHERE strlen(domain) < 32 GROUP BY ALL",
    "rtype_bucket": f"{BASE} SELECT rtype, rtype_l AS label, count(*) // 2 AS count FROM bucketed GROUP BY ALL",
    "rcode_bucket": f"{BASE} SELECT rcode, rcode_l AS label, count(*) // 2 AS count FROM bucketed GROUP BY ALL",
    "history_range": f"{HOURLY} SELECT * FROM hourly WHERE view = '{VIEW}' AND stamp >= '{FINE[0]}' AND stamp < '{FINE[1]}'",
    "strip_root_dot": f"{BASE} SELECT DISTINCT key, iname AS name, client_ip FROM bucketed WHERE iname IS NOT NULL",
    "loopback_filter": f"{BASE} SELECT client_ip, count(*) AS count FROM rec WHERE client_ip NOT IN ('127.0.0.1', '::1') GROUP BY 1",
    "same_network": f"""{BASE},
pairs AS (
  SELECT event_id AS position, client_ip AS a, CASE WHEN event_id % 5 = 0 THEN '2001:db8::' || (event_id % 7) ELSE '10.' || (event_id % 3) || '.7.9' END AS b,
         greatest(0, least(event_id % 37 - 2, event_id % 131)) AS m FROM rec
),
numbers AS (
  SELECT *, list_reduce(list_transform(string_split(a, '.'), lambda x: try_cast(x AS BIGINT)), lambda x, y: x * 256 + y) AS x,
         list_reduce(list_transform(string_split(b, '.'), lambda x: try_cast(x AS BIGINT)), lambda x, y: x * 256 + y) AS y FROM pairs
)
SELECT position, a, b, CASE WHEN {_V6.format('a')} <> {_V6.format('b')} THEN false
  WHEN {_V6.format('a')} THEN m < 125 OR (a[-1]::INTEGER >> (128 - least(m, 128))::INTEGER) = (b[-1]::INTEGER >> (128 - least(m, 128))::INTEGER)
  ELSE (x >> (32 - least(m, 32))) = (y >> (32 - least(m, 32))) END AS same FROM numbers""",
    "parse_cidr": f"{SUBNETS} SELECT position, cidr, net::VARCHAR AS net, len::VARCHAR AS len, CASE WHEN net IS NULL THEN 'FORMAT_ERROR' ELSE 'SUCCEED' END AS status FROM cidrs",
    "view_defaults": f"""{BASE},
sums AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE rcode = 'SERVFAIL') AS f, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM rec) - INTERVAL 10 SECOND) AS late FROM keyed GROUP BY key),
known AS (SELECT key AS view, late / 10.0::DOUBLE AS qps, (n - f)::DOUBLE / n AS r FROM sums)
SELECT view, qps, CASE WHEN r < 0.1 THEN 1.0 ELSE r END AS success_rate FROM known UNION ALL SELECT 'not' || view, 0.0, 1.0 FROM known""",
    "subnet_lpm": f"""{SUBNETS},
ips AS (SELECT client_ip, count(*) AS count, any_value(ip) AS ip FROM rec JOIN pfx ON position = event_id GROUP BY client_ip)
SELECT client_ip, (SELECT arg_max(info, len) FROM subnets WHERE (ips.ip >> (32 - len)) << (32 - len) = net) AS info, count FROM ips""",
    "subnet_insert": f"{SUBNETS} SELECT position, cidr, net::VARCHAR AS net, len::VARCHAR AS len, status FROM placed",
    "subnet_remove": f"""{SUBNETS},
asked AS (SELECT DISTINCT regexp_replace(cidr, '/1([0-9])$', '/2\\1') AS cidr FROM cidrs WHERE rcode = 'SERVFAIL'),
split AS (SELECT cidr, regexp_extract(cidr, '^([0-9.]+)/([0-9]+)$', 1) AS ip, try_cast(regexp_extract(cidr, '^([0-9.]+)/([0-9]+)$', 2) AS INTEGER) AS len FROM asked),
wanted AS (
  SELECT cidr, CASE WHEN ip <> '' AND len BETWEEN 1 AND 32 THEN ((list_reduce(list_transform(string_split(ip, '.'), lambda x: try_cast(x AS BIGINT)), lambda x, y: x * 256 + y) >> (32 - len)) << (32 - len))::BIGINT END AS net,
         CASE WHEN ip <> '' AND len BETWEEN 1 AND 32 THEN len END AS len FROM split
)
SELECT cidr, w.net::VARCHAR AS net, w.len::VARCHAR AS len, CASE WHEN w.net IS NULL THEN 'FORMAT_ERROR' WHEN s.net IS NULL THEN 'FAILED' ELSE 'SUCCEED' END AS status FROM wanted w LEFT JOIN subnets s ON w.net = s.net AND w.len = s.len
UNION ALL SELECT NULL, net::VARCHAR, len::VARCHAR, 'KEPT' FROM subnets s WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.net = s.net AND w.len = s.len)""",
    "closest_ancestor": f"""{BASE},
zones AS (SELECT zone || '.' AS zone FROM rec WHERE zone IN ('z1.com', 'z2.com') UNION SELECT {_LOOKUP.format('domain')} FROM rec WHERE domain LIKE 'view%' AND strlen(domain) < 32 UNION SELECT 'com.'),
names AS (SELECT DISTINCT domain AS name FROM rec)
SELECT name, (SELECT arg_max(zone, length(zone)) FROM zones WHERE strlen(name) < 32 AND ({_LOOKUP.format('name')} = zone OR ends_with({_LOOKUP.format('name')}, '.' || zone))) AS zone FROM names""",
    "exact_lookup": f"""{BASE},
counts AS (SELECT key, dname, count(*) AS count FROM bucketed WHERE dname IS NOT NULL GROUP BY ALL),
asked AS (SELECT DISTINCT view || '$' || zone AS key, regexp_replace(domain, '^click', 'clicks') AS name FROM rec)
SELECT a.key, name, count::VARCHAR AS count FROM asked a LEFT JOIN counts c ON a.key = c.key AND strlen(name) < 32 AND {_LOOKUP.format('name')} = dname""",
    "live_series_fill": f"{SAMPLES} SELECT key, stamp, qps FROM samples",
    "domain_counts": f"{BASE} SELECT key, dname AS name, count(*) AS count FROM bucketed WHERE dname IS NOT NULL GROUP BY ALL",
    "ip_counts": f"{BASE} SELECT key, iname AS name, count(*) AS count FROM bucketed WHERE iname IS NOT NULL GROUP BY ALL",
    "rcode_counts": f"{BASE} SELECT key, rcode_l AS rcode, count(*) AS count FROM bucketed GROUP BY ALL",
    "rtype_counts": f"{BASE} SELECT key, rtype_l AS rtype, count(*) AS count FROM bucketed GROUP BY ALL",
    "query_totals": f"{BASE} SELECT key, count(*) AS count FROM keyed GROUP BY ALL",
    "success_rate": f"{BASE} SELECT key, round(count(*) FILTER (WHERE rcode <> 'SERVFAIL') / count(*)::DOUBLE, 6) AS success_rate FROM keyed GROUP BY ALL",
    "distinct_names": f"{BASE} SELECT key, count(DISTINCT dname) AS domains, count(DISTINCT iname) AS clients FROM bucketed GROUP BY key",
    "property_totals": f"{HOURLY} SELECT *, 'rcode' AS kind FROM ({_range('hourly', 'rcode', FINE)}) UNION ALL SELECT *, 'rtype' FROM ({_range('hourly', 'rtype', FINE)})",
    "half_hour_mean": f"{MEANS} SELECT key, stamp, round(qps, 6) AS qps, round(success_rate, 6) AS success_rate FROM half",
    "latest_stamp": f"{HOURLY} SELECT kind, max(stamp) AS stamp FROM hourly GROUP BY kind UNION ALL SELECT 'none', '20130101010101'",
    "total_views": f"{BASE} SELECT zone, dname AS name, count(*) // 2 AS count FROM bucketed WHERE dname IS NOT NULL GROUP BY ALL",
    "domain_topn": f"{BASE} {_top('dname', 5)}",
    "ip_topn": f"{BASE} SELECT key, name[:-2] AS client_ip, count, rank FROM ({_top('iname', 1000)})",
    "property_sorted": f"""{BASE},
both_kinds AS (
  SELECT 'rcode' AS kind, key, rcode_l AS item, count(*) AS count, list_position(['NOERROR', 'FORMATERR', 'SERVFAIL', 'NXDOMAIN', 'NOTIMP', 'REFUSED', 'OTHER'], rcode_l) AS place FROM bucketed GROUP BY ALL
  UNION ALL SELECT 'rtype', key, rtype_l, count(*), list_position(['A', 'MX', 'AAAA', 'CNAME', 'NS', 'SOA', 'TXT', 'SPF', 'SRV', 'DNAME', 'NAPTR', 'OTHER'], rtype_l) FROM bucketed GROUP BY ALL
)
SELECT kind, key, item, count, CAST(row_number() OVER (PARTITION BY kind, key ORDER BY count DESC, place) AS INTEGER) AS rank FROM both_kinds""",
    "history_topn": f"{HOURLY} {_range('hourly', 'domain', FINE)} ORDER BY query_num DESC, item LIMIT 10",
    "views_list": f"{BASE} SELECT DISTINCT key FROM keyed",
    "subnet_list": f"{SUBNETS} SELECT net, len, info, count(*) OVER () AS size FROM subnets",
    "qps_10s": f"{BASE} SELECT key, {_STAMP.format(_end('ts', '10 seconds'))} AS stamp, count(*) / 10.0::DOUBLE AS qps FROM keyed GROUP BY ALL",
    "whole_point": f"{BASE} SELECT DISTINCT {_STAMP.format('ts')} AS stamp, {_STAMP.format('''time_bucket(INTERVAL '5 minutes', ts)''')} AS whole FROM rec",
    "five_minute_samples": f"{SAMPLES} SELECT key, stamp, qps, round(success_rate, 6) AS success_rate FROM samples",
    "hourly_snapshot": f"{HOURLY} SELECT * FROM hourly",
    "half_hour_rollup": f"{MEANS} SELECT 'qps' AS series, key AS view, stamp, round(qps, 6) AS value FROM half UNION ALL SELECT 'success_rate', key, stamp, round(success_rate, 6) FROM half",
    "daily_rollup": f"{DAILY} SELECT * FROM daily",
    "retention": f"{HOURLY} SELECT * FROM hourly WHERE stamp >= '20240113000000'",
    "series_read": f"""{MEANS},
every AS (
  SELECT 'fine' AS span, 'qps' AS series, stamp, round(qps, 6) AS value, key FROM samples WHERE stamp >= '{FINE[0]}' AND stamp < '{FINE[1]}'
  UNION ALL SELECT 'fine', 'success_rate', stamp, round(success_rate, 6), key FROM samples WHERE stamp >= '{FINE[0]}' AND stamp < '{FINE[1]}'
  UNION ALL SELECT 'long', 'qps', stamp, round(qps, 6), key FROM half WHERE stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}'
  UNION ALL SELECT 'long', 'success_rate', stamp, round(success_rate, 6), key FROM half WHERE stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}'
),
own AS (SELECT * EXCLUDE (key) FROM every WHERE key = '{VIEW}')
{_thin('own', 'span, series', 'stamp')}""",
    "nic_rate_read": f"""{_FIVE},
own AS (SELECT * FROM five WHERE ethn = 'eth0' AND stamp >= '{FINE[0]}' AND stamp < '{FINE[1]}')
SELECT ethn, stamp, round(rx_rate, 6) AS rx_rate, round(tx_rate, 6) AS tx_rate FROM ({_thin('own', 'ethn', 'stamp')})""",
    "nic_rate_long": f"""{_FIVE},
long AS (
  SELECT ethn, {_STAMP.format(_end("strptime(stamp, '%Y%m%d%H%M%S')", "30 minutes"))} AS stamp, avg(rx_rate) AS rx_rate, avg(tx_rate) AS tx_rate FROM five GROUP BY ALL
),
own AS (SELECT * FROM long WHERE ethn = 'eth0' AND stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}')
SELECT ethn, stamp, round(rx_rate, 6) AS rx_rate, round(tx_rate, 6) AS tx_rate FROM ({_thin('own', 'ethn', 'stamp')})""",
    "downsample": f"""WITH own AS (SELECT event_type, strftime(ts, '%Y%m%d%H%M%S%f') AS stamp, event_id FROM events)
{_thin('own', 'event_type', 'stamp, event_id')}""",
    "long_topn": f"{DAILY} {_long('domain', 10)} UNION ALL {_long('ip', 10)}",
    "long_property": f"{DAILY} {_long('rcode', None)} UNION ALL {_long('rtype', None)}",
    "stream_counts": f"{HOURLY} SELECT kind, stamp AS hour, key, name, n AS count FROM counted",
    "stream_qps": f"{BASE} SELECT key, {_STAMP.format(_end('ts', '10 seconds'))} AS stamp, count(*) / 10.0::DOUBLE AS qps FROM keyed GROUP BY ALL",
    "stream_topn": f"{HOURLY} SELECT kind, stamp AS hour, key, name, n AS count, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 10 AND kind IN ('domain', 'ip')",
    "stream_samples": f"{HOURLY} SELECT * FROM hourly",
}

#: What a stream with a watermark of ten minutes has given at the log's end.
_PASSED = f"<= (SELECT {_STAMP.format("max(ts) - INTERVAL 10 MINUTE")} FROM rec)"
ORACLES |= {
    "subnet_ranges": ORACLES["subnet_lpm"],
    "prefix_ancestor": ORACLES["closest_ancestor"],
    "range_cover": f"{HOURLY} SELECT kind, item, CAST(sum(query_num) AS BIGINT) AS query_num FROM hourly WHERE view = '{VIEW}' AND stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}' GROUP BY kind, item",
    "late_hours": ORACLES["hourly_snapshot"],
    "late_days": ORACLES["daily_rollup"],
    "stream_tail": _REASONS,
    "distinct_range": f"""{BASE},
spans AS (SELECT * FROM bucketed WHERE {_HOUR} >= '{COARSE[0]}' AND {_HOUR} < '{COARSE[1]}')
SELECT key, 'domains' AS kind, count(DISTINCT dname) AS names, true AS within FROM spans WHERE dname IS NOT NULL GROUP BY key
UNION ALL SELECT key, 'clients', count(DISTINCT iname), true FROM spans WHERE iname IS NOT NULL GROUP BY key""",
    "qps_ticks": f"""{ORACLES['qps_10s'].replace('SELECT key, strftime', ', ticks AS (SELECT key, strftime', 1)}),
every AS (SELECT key, {_STAMP.format('t')} AS stamp FROM (SELECT DISTINCT key FROM ticks), (SELECT unnest(generate_series(strptime('{FINE[0]}', '%Y%m%d%H%M%S'), strptime('{DAY_END}', '%Y%m%d%H%M%S') - INTERVAL 10 SECOND, INTERVAL 10 SECOND)) AS t))
SELECT key, stamp, coalesce(qps, 0.0::DOUBLE) AS qps FROM every LEFT JOIN ticks USING (key, stamp)""",
    "heavy_hitters": f"""{HOURLY},
spans AS (SELECT kind, stamp, key, name, n AS lower, n AS over FROM counted WHERE kind IN ('domain', 'ip') AND stamp >= '{COARSE[0]}' AND stamp < '{COARSE[1]}'),
{_cut('hours', 'spans', 'kind, stamp, key')},
by_day AS (SELECT kind, stamp[1:8] AS stamp, key, name, sum(lower) AS lower, sum(over) AS over FROM hours GROUP BY ALL),
{_cut('days', 'by_day', 'kind, stamp, key')},
together AS (SELECT kind, key, name, sum(lower) AS lower, sum(over) AS over FROM days GROUP BY ALL),
{_cut('whole', 'together', 'kind, key')},
missing AS (SELECT kind, key, sum(over) AS unlisted FROM whole WHERE name IS NULL GROUP BY ALL),
exact AS (SELECT kind, key, name, sum(over) AS count FROM spans GROUP BY ALL)
SELECT kind, key, name, lower::BIGINT AS lower, (over + unlisted)::BIGINT AS upper, unlisted::BIGINT AS unlisted, count::BIGINT AS count, true AS within
FROM whole JOIN missing USING (kind, key) JOIN exact USING (kind, key, name)""",
    "stream_five_minutes": f"{ORACLES['five_minute_samples']} WHERE stamp {_PASSED}",
    "stream_half_hours": f"{ORACLES['half_hour_mean']} WHERE stamp {_PASSED}",
    "stream_top_lists": ORACLES["stream_topn"],
}
