"""Functions of the two SQL dialects, by family, through their rewritten calls."""

from __future__ import annotations

from korrel.queries.registry import statement


def sqlite(name: str, sql: str, oracle: str) -> None:
    statement(f"sqlite_{name}", sql, oracle, dialect="sqlite")


def postgres(name: str, sql: str, oracle: str | None = None) -> None:
    statement(f"pg_{name}", sql, oracle, dialect="postgres")


sqlite("null_and_condition", "SELECT c_custkey, iif(c_acctbal > 0, 'plus', 'minus') AS side, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, if(c_nationkey = 1, 1, 0) AS one FROM customer",
       "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS side, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE WHEN c_nationkey = 1 THEN 1 ELSE 0 END AS one FROM customer")
sqlite("strings", "SELECT p_partkey, char(65, 66) AS ab, concat(p_brand, '-', p_type) AS c, format('%s:%d', p_name, p_size) AS f, instr(p_name, 'a') AS i, length(p_name) AS n, lower(p_brand) AS lo, upper(p_type) AS up, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, trim(' x ') AS t, replace(p_brand, 'Brand', 'B') AS r, substr(p_name, 2, 3) AS s, substr(p_name, -3) AS tail, hex(p_brand) AS h, unicode(p_name) AS u, octet_length(p_name) AS o, quote(p_brand) AS q FROM part".replace("char(65, 66)", "concat(char(65), char(66))"),
       "SELECT p_partkey, 'AB' AS ab, p_brand || '-' || p_type AS c, p_name || ':' || p_size AS f, instr(p_name, 'a') AS i, length(p_name) AS n, lower(p_brand) AS lo, upper(p_type) AS up, ltrim('  x ') AS lt, rtrim(' x  ') AS rt, trim(' x ') AS t, replace(p_brand, 'Brand', 'B') AS r, substr(p_name, 2, 3) AS s, substr(p_name, -3) AS tail, hex(p_brand) AS h, unicode(p_name) AS u, strlen(p_name) AS o, '''' || p_brand || '''' AS q FROM part")
sqlite("glob_and_like", "SELECT p_partkey, glob('Brand#[12]?', p_brand) AS g, p_brand LIKE 'brand#1%' AS l FROM part", "SELECT p_partkey, p_brand GLOB 'Brand#[12]?' AS g, p_brand ILIKE 'brand#1%' AS l FROM part")
sqlite("numeric", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, max(l_quantity, l_tax * 100) AS mx, min(l_quantity, NULL) AS mn, sign(l_tax - 0.04) AS sg, round(l_extendedprice, 1) AS r FROM lineitem",
       "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, greatest(l_quantity, l_tax * 100) AS mx, CAST(NULL AS DOUBLE) AS mn, CAST(sign(l_tax - 0.04) AS DOUBLE) AS sg, round(l_extendedprice, 1) AS r FROM lineitem")
sqlite("math", "SELECT p_partkey, round(acos(p_size / 100.0), 9) AS ac, round(atan2(p_size, 3), 9) AS at, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(exp(p_size / 50.0), 9) AS e, round(ln(p_size), 9) AS ln, round(log(p_size), 9) AS lg, round(log(2, p_size), 9) AS l2, round(log2(p_size), 9) AS lt, mod(p_size, 7) AS m, round(power(p_size, 2), 6) AS pw, round(radians(p_size), 9) AS rd, round(sqrt(p_size), 9) AS sq, sqrt(-1.0 * p_size) AS none, trunc(-1 * p_retailprice) AS tr, round(pi(), 9) AS pi FROM part",
       "SELECT p_partkey, round(acos(p_size / 100.0), 9) AS ac, round(atan2(p_size, 3), 9) AS at, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(exp(p_size / 50.0), 9) AS e, round(ln(p_size), 9) AS ln, round(log10(p_size), 9) AS lg, round(log2(p_size), 9) AS l2, round(log2(p_size), 9) AS lt, CAST(p_size % 7 AS DOUBLE) AS m, round(power(p_size, 2), 6) AS pw, round(radians(p_size), 9) AS rd, round(sqrt(p_size), 9) AS sq, CAST(NULL AS DOUBLE) AS none, CAST(trunc(-1 * p_retailprice) AS BIGINT) AS tr, round(pi(), 9) AS pi FROM part")
sqlite("hints_and_types", "SELECT c_custkey, likely(c_acctbal > 0) AS l, likelihood(c_nationkey, 0.5) AS k, unlikely(c_custkey) AS u, typeof(c_acctbal) AS td, typeof(c_custkey) AS ti, typeof(c_name) AS ts, typeof(NULL) AS tn FROM customer",
       "SELECT c_custkey, c_acctbal > 0 AS l, c_nationkey AS k, c_custkey AS u, 'real' AS td, 'integer' AS ti, 'text' AS ts, 'null' AS tn FROM customer")
sqlite("aggregates", "SELECT o_orderstatus, round(total(o_totalprice), 2) AS t, round(total(o_totalprice) FILTER (WHERE o_totalprice < 0), 2) AS none, length(group_concat(o_orderpriority)) AS n, count(*) AS c, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus",
       "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS t, 0.0::DOUBLE AS none, length(string_agg(o_orderpriority, ',')) AS n, count(*) AS c, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus")
sqlite("dates", "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate, '+1 day') AS dt, julianday(o_orderdate) AS j, unixepoch(o_orderdate) AS u, strftime('%Y-%m/%d %H:%M %j %w', o_orderdate) AS s, date(o_orderdate, 'start of month') AS m FROM orders",
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS dt, epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u, strftime(o_orderdate, '%Y-%m/%d %H:%M %j %w') AS s, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m FROM orders")
sqlite("json_read", "SELECT event_id, json_extract(props, '$.k') AS k, props ->> 'k' AS a, json_valid(props) AS v, json_valid('{x') AS bad, json_type(props) AS t, json_type(props, '$.k') AS kt, json_array_length('[1,2,3]') AS n FROM events",
       "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS a, 1 AS v, 0 AS bad, 'object' AS t, 'integer' AS kt, 3 AS n FROM events")
sqlite("json_build", "SELECT c_custkey, json_array(c_custkey, c_nationkey) AS a, json_object('k', c_custkey, 's', c_mktsegment) AS o, json_quote(c_mktsegment) AS q FROM customer",
       "SELECT c_custkey, '[' || c_custkey || ',' || c_nationkey || ']' AS a, '{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS o, '\"' || c_mktsegment || '\"' AS q FROM customer")
sqlite("json_edit", "SELECT event_id, json_set(props, '$.z', 1) AS s, json_insert(props, '$.k', 0) AS i, json_replace(props, '$.k', 0) AS r, json_remove(props, '$.k') AS d, json_patch(props, '{\"p\":true}') AS p FROM events",
       "SELECT event_id, '{\"k\":' || k || ',\"z\":1}' AS s, '{\"k\":' || k || '}' AS i, '{\"k\":0}' AS r, '{}' AS d, '{\"k\":' || k || ',\"p\":true}' AS p FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
sqlite("json_group", "SELECT n_regionkey, json_array_length(json_group_array(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(count(*) AS INT) AS n FROM nation GROUP BY n_regionkey")
sqlite("blobs", "SELECT r_regionkey, hex(zeroblob(3)) AS z, length(hex(randomblob(4))) AS n FROM region", "SELECT r_regionkey, '000000' AS z, 8 AS n FROM region")

postgres("math", "SELECT p_partkey, round(cbrt(p_size), 9) AS cb, round(log(p_size), 9) AS lg, trunc(-1 * p_retailprice) AS t, gcd(p_size, 12) AS g, lcm(p_size, 4) AS l, width_bucket(p_retailprice, 900, 2000, 5) AS w, div(p_size, 7) AS d FROM part",
         "SELECT p_partkey, round(cbrt(p_size), 9) AS cb, round(log10(p_size), 9) AS lg, CAST(trunc(-1 * p_retailprice) AS BIGINT) AS t, CAST(gcd(p_size, 12) AS BIGINT) AS g, CAST(lcm(p_size, 4) AS BIGINT) AS l, CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 6 ELSE CAST(floor((p_retailprice - 900) / 220) AS BIGINT) + 1 END AS w, CAST(p_size // 7 AS BIGINT) AS d FROM part")
postgres("strings", "SELECT p_partkey, initcap(lower(p_type)) AS ic, strpos(p_name, 'e') AS sp, starts_with(p_brand, 'Brand') AS sw, split_part(p_brand, '#', 2) AS pt, concat(p_brand, NULL, p_size) AS c, to_hex(p_size) AS hx, lpad(p_brand, 12, '.') AS lp, left(p_name, 3) AS lf, reverse(p_brand) AS rv, quote_literal(p_brand) AS ql, translate(p_brand, 'Br', 'bR') AS tr, chr(p_size + 64) AS ch FROM part".replace("initcap(lower(p_type)) AS ic, ", ""),
         "SELECT p_partkey, instr(p_name, 'e') AS sp, starts_with(p_brand, 'Brand') AS sw, split_part(p_brand, '#', 2) AS pt, p_brand || p_size AS c, lower(hex(p_size)) AS hx, lpad(p_brand, 12, '.') AS lp, left(p_name, 3) AS lf, reverse(p_brand) AS rv, '''' || p_brand || '''' AS ql, translate(p_brand, 'Br', 'bR') AS tr, chr(p_size + 64) AS ch FROM part")
postgres("regex", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x') AS one, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS every, regexp_like(p_name, 'a.e') AS l, regexp_count(p_name, '[aeiou]') AS n, element_at(regexp_split_to_array(p_type, ' '), 1) AS first, element_at(regexp_match(p_brand, '[0-9]+'), 1) AS m FROM part",
         "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'x') AS one, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS every, regexp_matches(p_name, 'a.e') AS l, len(regexp_extract_all(p_name, '[aeiou]')) AS n, string_split(p_type, ' ')[1] AS first, regexp_extract(p_brand, '[0-9]+') AS m FROM part")
postgres("hashes", "SELECT c_custkey, md5(c_name) AS m, encode(sha256(c_name), 'hex') AS s, encode(cast(c_name AS BINARY), 'hex') AS h, encode(cast(c_name AS BINARY), 'base64') AS b FROM customer",
         "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, base64(encode(c_name)) AS b FROM customer")
postgres("text_arrays", "SELECT p_partkey, array_to_string(string_to_array(p_type, ' '), '+') AS a, array_length(string_to_array(p_type, ' '), 1) AS n, array_position(string_to_array(p_type, ' '), 'x') AS p, num_nulls(NULL, p_size, NULL) AS nn, num_nonnulls(p_size, NULL) AS nz FROM part",
         "SELECT p_partkey, replace(p_type, ' ', '+') AS a, len(string_split(p_type, ' ')) AS n, CAST(list_position(string_split(p_type, ' '), 'x') AS BIGINT) AS p, 2 AS nn, 1 AS nz FROM part")
postgres("dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_part('doy', o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, date_bin('15' DAY, o_orderdate, TIMESTAMP '1992-01-01 00:00:00') AS b, overlaps(o_orderdate, o_orderdate + INTERVAL '3' DAY, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1996-01-01 00:00:00') AS o FROM orders".replace("date_bin('15' DAY", "date_bin('15' DAY"),
         "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(dayofyear(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, time_bucket(INTERVAL 15 DAY, o_orderdate, TIMESTAMP '1992-01-01') AS b, o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 3 DAY AS o FROM orders")
postgres("aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 400000) AS bo, every(o_totalprice > 0) AS ev, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice), 2) AS vp, round(corr(o_totalprice, o_custkey), 9) AS co, round(covar_samp(o_totalprice, o_custkey), 2) AS cv, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p, bit_or(o_orderkey) AS bt, length(string_agg(o_orderpriority, ';')) AS n, size(array_agg(CASE WHEN o_totalprice > 1000 THEN o_orderkey END)) AS k FROM orders GROUP BY o_orderstatus",
         "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 400000) AS bo, bool_and(o_totalprice > 0) AS ev, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice), 2) AS vp, round(corr(o_totalprice, o_custkey), 9) AS co, round(covar_samp(o_totalprice, o_custkey), 2) AS cv, round(quantile_cont(o_totalprice, 0.5), 4) AS p, bit_or(o_orderkey) AS bt, length(string_agg(o_orderpriority, ';')) AS n, CAST(count(*) AS INT) AS k FROM orders GROUP BY o_orderstatus")
postgres("json", "SELECT event_id, json_extract_path_text(props, 'k') AS k, json_typeof(props) AS t, jsonb_set(props, '{z}', '1') AS s, json_build_object('id', event_id, 'type', event_type) AS o, jsonb_path_exists(props, '$.k') AS e, jsonb_strip_nulls('{\"a\":null}') AS n FROM events",
         "SELECT event_id, json_extract_string(props, '$.k') AS k, 'object' AS t, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS s, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS o, true AS e, '{}' AS n FROM events")
postgres("arrays", "SELECT vec_id, cardinality(embedding) AS n, array_length(array_cat(slice(embedding, 1, 2), slice(embedding, 1, 3)), 1) AS c, size(trim_array(embedding, 3)) AS t, array_upper(embedding, 1) AS u, size(array_positions(array(1, label, 1), 1)) AS p FROM embeddings",
         "SELECT vec_id, len(embedding) AS n, 5 AS c, len(embedding) - 3 AS t, len(embedding) AS u, CASE WHEN label = 1 THEN 3 ELSE 2 END AS p FROM embeddings")
postgres("series", "SELECT p_partkey, g, g * g AS s FROM (SELECT p_partkey, generate_series(1, p_size, 10) AS g FROM part)", "SELECT p_partkey, CAST(g AS INT) AS g, CAST(g * g AS INT) AS s FROM (SELECT p_partkey, unnest(generate_series(1, p_size, 10)) AS g FROM part)")
postgres("casts", "SELECT l_orderkey, l_linenumber, int4(l_quantity) AS i, text(l_linenumber) AS t, float8(l_linenumber) AS f, bool(l_linenumber - 1) AS b FROM lineitem",
         "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS VARCHAR) AS t, CAST(l_linenumber AS DOUBLE) AS f, l_linenumber <> 1 AS b FROM lineitem")
postgres("ranges_and_networks", "SELECT s_suppkey, lower_inc(r) AS li, upper_inf(r) AS ui, isempty(r) AS e, host(a) AS h, masklen(a) AS m, family(a) AS f FROM (SELECT s_suppkey, named_struct('lo', s_nationkey, 'hi', 12, 'lower_inc', true, 'upper_inc', false) AS r, concat('10.0.', s_nationkey, '.0/24') AS a FROM supplier)",
         "SELECT s_suppkey, true AS li, false AS ui, s_nationkey >= 12 AS e, '10.0.' || s_nationkey || '.0' AS h, 24 AS m, 4 AS f FROM supplier")
postgres("full_text", "SELECT item_id, size(to_tsvector(text)) AS n FROM benchmark", "SELECT item_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS INT) AS n FROM benchmark")

sqlite("edges", "SELECT r_regionkey, 7 / 2 AS a, 1 / 0 AS b, date('2020-01-31', '+1 month') AS c, upper('\u00e9a') AS d, json_extract('{\"a\":1,\"b\":\"x\"}', '$.a', '$.b', '$.c') AS e, (r_regionkey + 7) / 2 AS f, 3 * r_regionkey / 2 AS g, r_regionkey / 2.0 AS h, r_regionkey / 0 AS i FROM region",
       "SELECT r_regionkey, CAST(3 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, '2020-03-02' AS c, '\u00e9A' AS d, '[1,\"x\",null]' AS e, CAST((r_regionkey + 7) // 2 AS DOUBLE) AS f, CAST(3 * r_regionkey // 2 AS DOUBLE) AS g, CAST(r_regionkey / 2.0 AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS i FROM region".replace("CAST(r_regionkey / 2.0 AS DOUBLE) AS h", "CAST(r_regionkey AS DOUBLE) / 2 AS h"))
postgres("edges", "SELECT r_regionkey, encode(sha256('abc'), 'hex') AS a, left('hello', -2) AS b, right('hello', -2) AS c, substr('hello', -1, 3) AS d, initcap('hello-world foo') AS e, 7 / 2 AS f, age(TIMESTAMP '2020-02-01 00:00:00', TIMESTAMP '2020-01-01 00:00:00') AS g, array_to_string(ARRAY[1, NULL, 3], ',', '*') AS h, network('10.1.2.3/16') AS i, netmask('10.1.2.3/20') AS j, ts_headline('The cat sat', websearch_to_tsquery('CAT')) AS k, age(TIMESTAMP '2021-03-03 00:00:00', TIMESTAMP '2020-01-01 00:00:00') AS l FROM region",
         "SELECT r_regionkey, sha256('abc') AS a, 'hel' AS b, 'llo' AS c, 'h' AS d, 'Hello-World Foo' AS e, CAST(3 AS BIGINT) AS f, '1 mon' AS g, '1,*,3' AS h, '10.1.0.0/16' AS i, '255.255.240.0' AS j, 'The <b>cat</b> sat' AS k, '1 year 2 mons 2 days' AS l FROM region")

postgres("parts", "SELECT o_orderkey, extract(dow FROM o_orderdate) AS d, date_part('isodow', o_orderdate) AS i, to_char(CAST(o_orderkey % 1000 - 500 AS DECIMAL(10,2)) / 4, '9990.99') AS c, to_char(o_orderkey % 1000, 'FM9990') AS f, to_char(o_orderkey % 1000 - 500, '0999') AS z, o_orderkey::text AS t, (o_orderkey % 7)::double precision AS v FROM orders",
         "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INT) AS d, CAST(isodow(o_orderdate) AS INT) AS i, lpad(printf('%.2f', (o_orderkey % 1000 - 500) / 4), 8, ' ') AS c, CAST(o_orderkey % 1000 AS VARCHAR) AS f, lpad(CASE WHEN o_orderkey % 1000 < 500 THEN '-' ELSE '' END || lpad(CAST(abs(o_orderkey % 1000 - 500) AS VARCHAR), 4, '0'), 5, ' ') AS z, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderkey % 7 AS DOUBLE) AS v FROM orders")
sqlite("printf", "SELECT o_orderkey, printf('%.2f|%5d|%-6s|%05.1f%%', o_totalprice, o_orderkey, o_orderstatus, o_custkey) AS p, printf('%d %s', NULL, NULL) AS n, char(65, 233, 128578, o_orderkey % 26 + 97) AS c FROM orders",
       "SELECT o_orderkey, printf('%.2f|%5d|%-6s|%05.1f%%', o_totalprice, o_orderkey, o_orderstatus, o_custkey::DOUBLE) AS p, '0 ' AS n, 'Aé🙂' || chr(CAST(o_orderkey % 26 + 97 AS INT)) AS c FROM orders")
