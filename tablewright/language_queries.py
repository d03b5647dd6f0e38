"""The functions of the expression language as queries: every function stands in one, beside its equivalent in SQL.

Functions of values that SQL has no equivalent for are applied to constants, and the SQL states the results that their
published definitions give.
"""

from __future__ import annotations

from .operators import aggregate, rows
from .queries import q


def chosen(name: str, table: str, expressions: str, sql: str) -> None:
    """A query that selects expressions from a whole table."""
    q(name, sql, lambda t: rows.select(getattr(t, table), expressions, evaluate=True))


def golden(name: str, cases: dict[str, str]) -> None:
    """A query of expressions of constants and their results, as SQL, for each region."""
    expressions = ", ".join(f"{e} as c{i}" for i, e in enumerate(cases))
    results = ", ".join(f"{v} AS c{i}" for i, v in enumerate(cases.values()))
    chosen(name, "region", f"r_regionkey, {expressions}", f"SELECT r_regionkey, {results} FROM region")


# numbers

chosen("language_rounding", "orders", "o_orderkey, abs(o_totalprice - 200000) as a, neg(o_totalprice) as n, log2(o_totalprice) as l2, log10(o_totalprice) as l10, log(o_totalprice, 3) as l3, ceil(o_totalprice) as c, floor(o_totalprice) as f, round(o_totalprice) as r, trunc(o_totalprice) as t, ceil(o_totalprice, 100) as ch, round(o_totalprice, 100) as rh, trunc(0 - o_totalprice, 100) as th",
       """SELECT o_orderkey, abs(o_totalprice - 200000) AS a, -o_totalprice AS n, log2(o_totalprice) AS l2, log10(o_totalprice) AS l10, ln(o_totalprice) / ln(3) AS l3, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f,
CAST(floor(o_totalprice + 0.5) AS BIGINT) AS r, CAST(trunc(o_totalprice) AS BIGINT) AS t, ceil(o_totalprice / 100) * 100 AS ch, floor(o_totalprice / 100 + 0.5) * 100 AS rh, trunc(-o_totalprice / 100) * 100 AS th FROM orders""")
chosen("language_extremes", "nation", "n_nationkey, min(n_nationkey, 7) as lo, max(n_nationkey, n_regionkey, 3) as hi, min([n_nationkey, n_regionkey]) as ll, max([n_nationkey, 4]) as lh, argmin([n_nationkey, 5, n_regionkey]) as al, argmax([n_nationkey, 5, n_regionkey]) as ah, argmax([n_nationkey, 5], ['key', 'five']) as name, sum([n_nationkey, n_regionkey]) as s, mean([n_nationkey, n_regionkey, 2]) as m, sum(range(n_nationkey)) as triangle, int(last(n_name)) as digit, float(n_nationkey) as x, add(n_nationkey, 1, 2) as added, sub(n_nationkey, 1) as less, mul(n_nationkey, 2, 3) as times, pow(n_nationkey, 3) as cube",
       """WITH n AS (SELECT *, [n_nationkey, 5, n_regionkey] AS l FROM nation) SELECT n_nationkey, least(n_nationkey, 7) AS lo, greatest(n_nationkey, n_regionkey, 3) AS hi, least(n_nationkey, n_regionkey) AS ll, greatest(n_nationkey, 4) AS lh, list_position(l, list_min(l)) - 1 AS al, list_position(l, list_max(l)) - 1 AS ah,
CASE WHEN n_nationkey >= 5 THEN 'key' ELSE 'five' END AS name, n_nationkey + n_regionkey AS s, (n_nationkey + n_regionkey + 2) / 3 AS m, n_nationkey * (n_nationkey - 1) // 2 AS triangle, CAST(right(n_name, 1) AS INT) AS digit, n_nationkey::DOUBLE AS x, n_nationkey + 3 AS added, n_nationkey - 1 AS less, n_nationkey * 6 AS times, CAST(n_nationkey ** 3 AS BIGINT) AS cube FROM n""")
chosen("language_comparisons", "orders", "o_orderkey, o_orderpriority ne '5-LOW' as ne, o_orderpriority gt '3' as gt, o_orderpriority ge '2-HIGH' as ge, o_orderpriority lt '3' as lt, o_orderpriority le '2-HIGH' as le, o_orderpriority eq '5-LOW' as eq, o_totalprice > 200000 as g, o_totalprice >= 200000 as gq, o_totalprice < 200000 as l, o_totalprice <= 200000 as lq, o_orderkey == 7 as e, o_orderkey != 7 as n, o_orderstatus not in ['F', 'P'] as ni",
       "SELECT o_orderkey, o_orderpriority <> '5-LOW' AS ne, o_orderpriority > '3' AS gt, o_orderpriority >= '2-HIGH' AS ge, o_orderpriority < '3' AS lt, o_orderpriority <= '2-HIGH' AS le, o_orderpriority = '5-LOW' AS eq, o_totalprice > 200000 AS g, o_totalprice >= 200000 AS gq, o_totalprice < 200000 AS l, o_totalprice <= 200000 AS lq, o_orderkey = 7 AS e, o_orderkey <> 7 AS n, o_orderstatus NOT IN ('F', 'P') AS ni FROM orders")

# texts

chosen("language_formats", "part", "p_partkey, fmt('{} is {}', p_name, p_size) as f, fmt('{name}!', {name: p_name}) as fm, printf('%05d|%-12s|%.2f', p_partkey, p_name, p_retailprice) as pf, numfmt(p_partkey * 1000) as nf, to_fixed(p_retailprice, 3) as tf, bytesize(p_size * 100) as b, pad(p_name, 15, '*') as p, rpad(p_name, 15, '.') as rp, lpad(p_size, 4, '0') as lp, repeat(p_type, 2) as rep, escape_regex(p_brand ++ '.*') as er, concat(p_name, '/', p_size) as c",
       """SELECT p_partkey, p_name || ' is ' || p_size AS f, p_name || '!' AS fm, printf('%05d|%-12s|%.2f', p_partkey, p_name, p_retailprice) AS pf, format('{:,}', p_partkey * 1000) AS nf, printf('%.3f', p_retailprice) AS tf,
CASE WHEN p_size < 10 THEN p_size * 100 || ' B' ELSE printf('%.1f KB', p_size / 10) END AS b, CASE WHEN length(p_name) >= 15 THEN p_name ELSE rpad(lpad(p_name, (length(p_name) + (15 - length(p_name)) // 2)::INT, '*'), 15, '*') END AS p,
CASE WHEN length(p_name) >= 15 THEN p_name ELSE rpad(p_name, 15, '.') END AS rp, lpad(p_size::VARCHAR, 4, '0') AS lp, p_type || p_type AS rep, replace(p_brand, '#', '\\#') || '\\.\\*' AS er, p_name || '/' || p_size AS c FROM part""")
chosen("language_trimming", "part", "p_partkey, trim(concat('  ', p_name, ' ')) as t, ltrim(concat('  ', p_name, ' ')) as l, rtrim(concat('  ', p_name, ' ')) as r, trim(p_name, 'st') as ts, ltrim(p_name, 'srb') as ls, rtrim(p_name, 'gte') as rs, lower(p_type) as lo, upper(p_name) as up, len(p_name) as n, first(p_name) as f, last(p_name) as z, slice(p_name, 1, 4) as s, get(p_name, 0) as g, p_name[2] as i, p_name[-3:] as tail, md5(p_name) as m",
       """SELECT p_partkey, p_name AS t, p_name || ' ' AS l, '  ' || p_name AS r, trim(p_name, 'st') AS ts, ltrim(p_name, 'srb') AS ls, rtrim(p_name, 'gte') AS rs, lower(p_type) AS lo, upper(p_name) AS up, length(p_name) AS n, left(p_name, 1) AS f, right(p_name, 1) AS z,
p_name[2:4] AS s, left(p_name, 1) AS g, p_name[3:3] AS i, right(p_name, 3) AS tail, md5(p_name) AS m FROM part""")
chosen("language_matching", "part", "p_partkey, startswith(p_name, 's') as s, endswith(p_name, 't') as e, contains(p_name, 'in') as c, contains(p_name, /^[a-m]/) as cr, count(p_name, 'e') as n, count(p_name, /[aeiou]/) as nr, match(p_brand, /[0-9]+/) as m, match(p_name, regex('([a-z]+) ([a-z]+)'), 2) as mg, match(p_name, /zzz/) as mn, replace(p_name, /[aeiou]/, '_') as r, replace(p_name, ' ', '-') as rs, split(p_name, /[ai]/) as sp, split(p_name, ' ', 1) as s1, 'e' in p_name as i",
       r"""SELECT p_partkey, starts_with(p_name, 's') AS s, suffix(p_name, 't') AS e, contains(p_name, 'in') AS c, regexp_matches(p_name, '^[a-m]') AS cr, length(p_name) - length(replace(p_name, 'e', '')) AS n, len(regexp_extract_all(p_name, '[aeiou]')) AS nr, regexp_extract(p_brand, '[0-9]+') AS m,
regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS mg, CAST(NULL AS VARCHAR) AS mn, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, replace(p_name, ' ', '-') AS rs, regexp_split_to_array(p_name, '[ai]') AS sp, string_split(p_name, ' ') AS s1, contains(p_name, 'e') AS i FROM part""")
golden("language_names", {
    "soundex('Robert')": "'R163'", "soundex('Rupert')": "'R163'", "soundex('Ashcraft')": "'A261'", "soundex('Tymczak')": "'T522'", "soundex('Pfister')": "'P236'", "refined_soundex('Braz')": "'B1905'", "refined_soundex('testing')": "'T6036084'",
    "s_stemmer('ponies')": "'pony'", "s_stemmer('cats')": "'cat'", "s_stemmer('corpus')": "'corpus'", "s_stemmer('horses')": "'horse'", "unidecode('Crème brûlée Œuvre')": "'Creme brulee OEuvre'", "fingerprint(' Été  à la à ')": "'a ete la'", "fingerprint('b a, B!')": "'a b'",
    "html_unescape('a &lt; b &amp;&#233;')": "'a < b &é'", "lru('http://www.lemonde.fr:80/a/b?x=1#y')": "'s:http|t:80|h:fr|h:lemonde|h:www|p:a|p:b|q:x=1|f:y|'", "urljoin('http://a.org/b/c', '../d')": "'http://a.org/d'", "mime_ext('text/html')": "'html'",
    "parse_dataurl('data:text/plain;base64,aGVsbG8=')": "['text/plain', 'hello']", "shlex_split('a \"b c\" d')": "['a', 'b c', 'd']", "len(uuid())": "36", "random() < 1": "true", "random() >= 0": "true", "now() == now()": "true",
    "parse_py_literal(\"[1, 'x', None]\")[1].concat('!')": "'x!'",
})
golden("language_paths", {
    "basename('/a/b.txt')": "'b.txt'", "basename('/a/b.txt', '.txt')": "'b'", "dirname('/a/b.txt')": "'/a'", "dirname('b.txt')": "''", "ext('/a/b.tar.gz')": "'gz'", "pathjoin('a', 'b', '/c')": "'/c'", "pjoin('a', 'b/', 'c')": "'a/b/c'", "abspath('/a/../b')": "'/b'", "isfile('/no/such/file')": "false", "isfile('/proc/version')": "true",
    "filesize('/proc/version')": "0", "read('/dev/null')": "''",
})

# lists, maps and functions of higher order

chosen("language_lists", "part", "p_partkey, split(p_name, '') | dedup | sort | join(_, '') as letters, first(split(p_name, ' ')) as f, last(split(p_name, ' ')) as l, get(split(p_name, ' '), 1) as g, get(split(p_name, ' '), 9, 'none') as d, slice(split(p_name, ' '), 1) as s, compact(split(p_name, 'e')) as c, flatten([split(p_name, ' '), ['x']]) as fl, concat(split(p_name, ' '), 'y') as cc, range(p_size, 0, -10) as r, len(range(p_size)) as rn, keys({a: p_name, b: p_brand}) as k, values({a: p_name, b: p_brand}) as v, {a: p_name}.a as at, index_by([{id: p_brand, v: p_name}], 'id') | keys as ik, sort(split(p_name, ' '), reverse=true) as sr, repeat(['z'], 2) as rp",
       """SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_name, '.'))), '') AS letters, split_part(p_name, ' ', 1) AS f, string_split(p_name, ' ')[-1] AS l, split_part(p_name, ' ', 2) AS g, 'none' AS d, string_split(p_name, ' ')[2:] AS s, list_filter(string_split(p_name, 'e'), lambda x: x <> '') AS c,
list_concat(string_split(p_name, ' '), ['x']) AS fl, list_concat(string_split(p_name, ' '), ['y']) AS cc, range(p_size, 0, -10) AS r, p_size AS rn, ['a', 'b'] AS k, [p_name, p_brand] AS v, p_name AS at, [p_brand] AS ik, list_reverse_sort(string_split(p_name, ' ')) AS sr, ['z', 'z'] AS rp FROM part""")
chosen("language_higher", "part", "p_partkey, flat_map(split(p_name, ' '), x => [x, upper(x)]) as fm, find(split(p_name, ' '), x => x.contains('e')) as f, find_index(split(p_name, ' '), x => x.contains('e')) as fi, all(split(p_name, ' '), x => len(x) > 3) as al, any(split(p_name, ' '), x => len(x) > 5) as an, map(range(3), x => x * p_size) as m, filter(range(6), x => x % 2 == 0) as fl, contains([1, p_size], 7) as c, contains({a: 1}, 'a') as cm",
       """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, flatten(list_transform(w, lambda x: [x, upper(x)])) AS fm, list_filter(w, lambda x: contains(x, 'e'))[1] AS f, list_position(list_transform(w, lambda x: contains(x, 'e')), true) - 1 AS fi,
len(list_filter(w, lambda x: length(x) <= 3)) = 0 AS al, len(list_filter(w, lambda x: length(x) > 5)) > 0 AS an, [0, p_size, 2 * p_size] AS m, [0, 2, 4] AS fl, p_size = 7 AS c, true AS cm FROM p""")

# dates and times

chosen("language_dates", "orders", "o_orderkey, month(o_orderdate) as m, month_day(o_orderdate) as md, ymd(o_orderdate) as d, ym(o_orderdate) as ym, year_month_day(o_orderdate) as d2, strftime(date(o_orderdate) + span('1 month'), '%F') as later, strftime(datetime(o_orderdate) - span('36h'), '%F %T') as before, strftime(date(ymd(o_orderdate)), '%d.%m.%y') as parsed, strftime(datetime(strftime(o_orderdate, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S'), '%F %T') as shaped, strftime(latest(date(o_orderdate), date('1995-06-01')), '%F') as late, strftime(earliest(date(o_orderdate), date('1995-06-01')), '%F') as early, fractional_days('1990-01-01', date(o_orderdate)) as days, date(o_orderdate) >= date('1995-06-01') as past, strftime(time(o_orderdate), '%H:%M') as clock",
       """SELECT o_orderkey, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%m-%d') AS md, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%Y-%m-%d') AS d2, strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS before,
strftime(o_orderdate, '%d.%m.%y') AS parsed, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shaped, strftime(greatest(o_orderdate::DATE, DATE '1995-06-01'), '%Y-%m-%d') AS late, strftime(least(o_orderdate::DATE, DATE '1995-06-01'), '%Y-%m-%d') AS early, (o_orderdate::DATE - DATE '1990-01-01')::DOUBLE AS days, o_orderdate::DATE >= DATE '1995-06-01' AS past, strftime(o_orderdate, '%H:%M') AS clock FROM orders""")
chosen("language_instants", "orders", "o_orderkey, to_timestamp(from_timestamp(o_orderkey * 1000)) as s, to_timestamp_ms(from_timestamp_ms(o_orderkey)) as ms, to_timestamp(with_timezone('2024-07-01T12:00:00', 'Europe/Paris')) as paris, to_timestamp(with_tz('2024-01-01T12:00:00', 'America/New_York')) as york, to_timestamp(to_tz(with_tz('2024-01-01T12:00:00', 'Asia/Tokyo'), 'Europe/Paris')) as same, to_timestamp(to_timezone(from_timestamp(5), 'Asia/Tokyo')) as five, to_timestamp(with_local_tz(without_tz(from_timestamp(o_orderkey)))) as back, to_timestamp(to_local_tz(from_timestamp(7))) as seven",
       "SELECT o_orderkey, o_orderkey * 1000.0 AS s, o_orderkey AS ms, 1719828000.0 AS paris, 1704128400.0 AS york, 1704078000.0 AS same, 5.0 AS five, o_orderkey::DOUBLE AS back, 7.0 AS seven FROM orders")
golden("language_instants_named", {
    "to_timestamp(to_local_timezone(from_timestamp(9)))": "9.0", "to_timestamp(with_local_timezone(without_timezone(from_timestamp(11))))": "11.0", "typeof(1)": "'int'", "typeof(1.5)": "'float'", "typeof('a')": "'string'", "typeof([1])": "'list'", "typeof(true)": "'boolean'",
})

# columns by name and place, conditions

chosen("language_columns", "supplier", "s_suppkey, col('s_name') as c, col(2) as c2, col?('none') as cn, header(1) as h, header?(99) as hn, col_index('s_nationkey') as i, col_index?('none') as ci, len(cols()) as n, join(headers(), ',') as hs, unless(s_acctbal > 0, 'debt', 'fine') as u, or(s_acctbal < 0, s_nationkey == 3) as o, and(s_acctbal > 0, s_nationkey < 9) as a, not(s_acctbal > 0) as nt, try(int(s_name)) as t, warn(int(s_name)) as w, try(err('no')) as e, if(s_nationkey, 'some') as f",
       """SELECT s_suppkey, s_name AS c, s_nationkey AS c2, CAST(NULL AS VARCHAR) AS cn, 's_name' AS h, CAST(NULL AS VARCHAR) AS hn, 2 AS i, CAST(NULL AS INT) AS ci, 4 AS n, 's_suppkey,s_name,s_nationkey,s_acctbal' AS hs, CASE WHEN s_acctbal > 0 THEN 'fine' ELSE 'debt' END AS u, s_acctbal < 0 OR s_nationkey = 3 AS o,
s_acctbal > 0 AND s_nationkey < 9 AS a, NOT s_acctbal > 0 AS nt, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS w, CAST(NULL AS VARCHAR) AS e, CASE WHEN s_nationkey <> 0 THEN 'some' END AS f FROM supplier""")
q("language_neighbours", "SELECT s_suppkey, s_name || '|' || s_nationkey AS s_name, s_nationkey, s_acctbal FROM supplier", lambda t: rows.transform(t.supplier, "s_name", "concat(_, '|', next_col())"))
q("language_neighbours_before", "SELECT s_suppkey, s_name || '|' || s_suppkey AS s_name, s_nationkey, s_acctbal FROM supplier", lambda t: rows.transform(t.supplier, "s_name", "concat(_, '|', prev_col())"))
q("language_row_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer", lambda t: rows.map_columns(t.customer.select("c_custkey"), "row_index() as i", order_by="c_custkey"))

# aggregates

_P = "FROM orders GROUP BY o_orderpriority"
q("language_quantiles", f"""SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS q2, list_sort(list(o_totalprice))[floor(count(*) / 2)::INT + 1] AS hi, min(o_totalprice) AS q0, max(o_totalprice) AS q1, array_to_string(list_reverse_sort(list(o_custkey))[:3], '|') AS top, array_to_string(list_transform(list_sort(list((-o_totalprice, o_orderkey)))[:2], lambda x: x[2]), '|') AS at,
round(100.0 * avg((o_totalprice > 200000)::INT), 1)::VARCHAR || '%' AS pc {_P}""",
  lambda t: aggregate.groupby(t.orders, "o_orderpriority", "q2(o_totalprice) as q2, median_high(o_totalprice) as hi, quantile(o_totalprice, 0) as q0, quantile(o_totalprice, 1) as q1, top(3, o_custkey) as top, argtop(2, o_totalprice, o_orderkey) as at, percentage(o_totalprice > 200000, 1) as pc", order_by="o_orderkey"))
q("language_times", f"""SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b, epoch(max(o_orderdate) - min(o_orderdate)) / 3600 AS h {_P}""",
  lambda t: rows.select(aggregate.groupby(t.orders, "o_orderpriority", "earliest(o_orderdate) as a, latest(o_orderdate) as b, count_hours(o_orderdate) as h"), "o_orderpriority, strftime(a, '%F') as a, strftime(b, '%F') as b, h", evaluate=True))
q("language_years", "SELECT 3.5 AS y", lambda t: aggregate.agg(rows.select(t.region, "if(r_regionkey == 0, '2019-01-01', '2022-07-02T12:00:00') as d", evaluate=True), "count_years(d) as y"))
q("language_modes", """WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, array_to_string(list_sort(list(c_nationkey::VARCHAR) FILTER (n = m)), '|') AS modes, array_to_string(list_transform(list_sort(list((-n, c_nationkey::VARCHAR)))[:3], lambda x: x[2]), '|') AS common, array_to_string(list_transform(list_sort(list((-n, c_nationkey::VARCHAR)))[:3], lambda x: -x[1]), '|') AS counts
FROM (SELECT *, max(n) OVER (PARTITION BY c_mktsegment) AS m FROM c) GROUP BY 1""", lambda t: aggregate.groupby(t.customer, "c_mktsegment", "modes(c_nationkey) as modes, most_common(3, c_nationkey) as common, most_common_counts(3, c_nationkey) as counts"))
q("language_types", "SELECT 'int' AS a, 'string' AS b, 'float' AS c, 'mixed' AS d, 'string|int' AS e, 'int|empty' AS f, 'int' AS g", lambda t: aggregate.agg(t.nation, "type(n_nationkey) as a, type(n_name) as b, type(if(n_nationkey < 3, '1.5', '2')) as c, type(if(n_nationkey < 3, 'x', '2')) as d, types(if(n_nationkey < 3, 'x', '2')) as e, types(if(n_nationkey < 3, '', '2')) as f, types(n_nationkey) as g"))
q("language_spreads", "SELECT var_pop(value) AS v, stddev_pop(value) AS s, covar_pop(value, user_id) AS c, avg(value) AS a, stddev_samp(value) AS ss FROM events", lambda t: aggregate.agg(t.events, "var_pop(value) as v, stddev_pop(value) as s, covariance_pop(value, user_id) as c, avg(value) as a, stddev_sample(value) as ss"))
q("language_bars", "SELECT '█████' AS d, '▄▄▄█' AS l", lambda t: aggregate.agg(t.region, "dist(if(r_regionkey < 4, r_regionkey, 4), 5) as d, log_dist(r_regionkey, 4) as l"))
q("language_approximate", "SELECT event_type, true AS near, true AS middle FROM events GROUP BY 1",
  lambda t: rows.select(aggregate.groupby(t.events, "event_type", "approx_cardinality(user_id) as ac, cardinality(user_id) as c, approx_quantile(value, 0.5) as aq, median(value) as m"), "event_type, abs(ac - c) <= 0.05 * c as near, abs(aq - m) <= 0.05 * m as middle", evaluate=True))

# windows

_EV = "PARTITION BY user_id ORDER BY event_id"
q("language_windows", f"""SELECT event_id, row_number() OVER w - 1 AS i, CASE WHEN row_number() OVER (w) >= 5 THEN list_var_pop(list(value) OVER (w ROWS 4 PRECEDING)) END AS v, CASE WHEN row_number() OVER (w) >= 5 THEN list_stddev_pop(list(value) OVER (w ROWS 4 PRECEDING)) END AS s, CASE WHEN row_number() OVER (w) >= 2 THEN avg(value) OVER (w ROWS 1 PRECEDING) END AS a FROM events WINDOW w AS ({_EV})""",
  lambda t: aggregate.window(t.events, "row_index() as i, rolling_var(5, value) as v, rolling_stddev(5, value) as s, rolling_avg(2, value) as a", "event_id", "user_id").select("event_id", "i", "v", "s", "a"))
q("language_front_coding", """WITH n AS (SELECT s_suppkey, s_name, coalesce(lag(s_name) OVER (ORDER BY s_name), '') AS p FROM supplier), k AS (SELECT *, len(list_filter(range(1, 1 + least(length(s_name), length(p))), lambda i: left(s_name, i::INT) = left(p, i::INT))) AS n FROM n)
SELECT s_suppkey, n || ' ' || substr(s_name, n + 1) AS c FROM k""", lambda t: aggregate.window(t.supplier, "front_coding(s_name) as c", "s_name").select("s_suppkey", "c"))
