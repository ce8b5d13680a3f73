"""Scalar functions, group by group; the oracle says in other words what each function means."""

from .catalog import sql

sql("fn_string_basic", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, reverse(p_type) AS r, length(p_name) AS n, repeat(p_brand, 2) AS twice, left(p_name, 3) AS head, right(p_name, 3) AS tail FROM part",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, reverse(p_type) AS r, CAST(length(p_name) AS BIGINT) AS n, repeat(p_brand, 2) AS twice, left(p_name, 3) AS head, right(p_name, 3) AS tail FROM part")
sql("fn_string_pad", "SELECT c_custkey, lpad(c_mktsegment, 14, 'ab') AS l, rpad(c_mktsegment, 14, 'xy') AS r, lpad(c_name, 4, '*') AS cut, concat('[', space(3), ']') AS s FROM customer",
    "SELECT c_custkey, right(repeat('ab', 14) || c_mktsegment, 14) AS l, left(c_mktsegment || repeat('xy', 14), 14) AS r, right(c_name, 4) AS cut, '[   ]' AS s FROM customer")
sql("fn_string_substr", "SELECT p_partkey, substring(p_name, 3, 4) AS a, substr(p_name, 0, 2) AS b, substring(p_name, -5) AS c, substring(p_name, 900, 2) AS d FROM part",
    "SELECT p_partkey, substring(p_name, 3, 4) AS a, substring(p_name, 1, 2) AS b, p_name AS c, '' AS d FROM part")
sql("fn_string_trim", r"SELECT n_nationkey, trim(concat('\t ', n_name, ' \n')) AS a, ltrim(concat('  ', n_name)) AS b, rtrim(concat(n_name, '  ')) AS c, trim(n_name, 'AEI') AS d, ltrim(n_name, 'A') AS e, rtrim(n_name, 'A') AS f FROM nation",
    "SELECT n_nationkey, n_name AS a, n_name AS b, n_name AS c, trim(n_name, 'AEI') AS d, ltrim(n_name, 'A') AS e, rtrim(n_name, 'A') AS f FROM nation")
sql("fn_string_concat_nulls", "SELECT n_nationkey, concat(n_name, NULL, '-', n_regionkey) AS a, concat_ws('/', n_name, NULL, 'x') AS b FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, n_name || '/x' AS b FROM nation")
sql("fn_string_search", "SELECT p_partkey, instr(p_name, 'a') AS at, replace(p_name, 'a', '_A_') AS r, strcmp(p_brand, 'Brand#30') AS c FROM part",
    "SELECT p_partkey, CAST(instr(p_name, 'a') AS BIGINT) AS at, replace(p_name, 'a', '_A_') AS r, CAST(CASE WHEN p_brand < 'Brand#30' THEN -1 WHEN p_brand > 'Brand#30' THEN 1 ELSE 0 END AS BIGINT) AS c FROM part")
sql("fn_unicode_lengths", "SELECT doc_id, char_length(text) AS chars, byte_length(text) AS bytes, reverse(left(text, 20)) AS back FROM documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, reverse(left(text, 20)) AS back FROM documents")
sql("fn_math_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS a, round(l_discount) AS b, round(l_extendedprice, -2) AS c, floor(l_tax * 100) AS f, ceil(l_quantity / 7.0) AS g FROM lineitem",
    "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS a, floor(l_discount + 0.5) AS b, floor(l_extendedprice * pow(10, -2) + 0.5) / pow(10, -2) AS c, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_quantity / 7.0) AS BIGINT) AS g FROM lineitem")
sql("fn_math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal) AS s, mod(c_custkey, 7) AS m, power(c_custkey, 2) AS p, sqrt(c_custkey) AS q FROM customer",
    "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS s, CAST(c_custkey % 7 AS BIGINT) AS m, pow(c_custkey, 2) AS p, sqrt(c_custkey) AS q FROM customer")
sql("fn_math_log_exp", "SELECT p_partkey, round(log(p_retailprice), 9) AS a, round(log(p_retailprice, 2), 9) AS b, round(log10(p_retailprice), 9) AS c, round(log2(p_retailprice), 9) AS d, round(exp(p_size / 10.0), 6) AS e FROM part",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS a, round(ln(p_retailprice) / ln(2), 9) AS b, round(log10(p_retailprice), 9) AS c, round(log2(p_retailprice), 9) AS d, round(exp(p_size / 10.0), 6) AS e FROM part")
sql("fn_math_trig", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 9) AS t, round(radians(n_nationkey), 9) AS r, round(degrees(n_nationkey), 6) AS d FROM nation")
sql("fn_math_gcd_lcm", "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l FROM part", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
sql("fn_math_null_on_error", "SELECT n_nationkey, sqrt(n_nationkey - 10) AS q, mod(n_nationkey, n_regionkey) AS m FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN sqrt(n_nationkey - 10) END AS q, CAST(n_nationkey % nullif(n_regionkey, 0) AS BIGINT) AS m FROM nation")
sql("fn_date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, quarter(ts) AS q FROM events",
    "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, CAST(quarter(ts) AS BIGINT) AS q FROM events")
sql("fn_date_arith", "SELECT o_orderkey, date_add(o_orderdate, 30) AS a, date_sub(o_orderdate, 7) AS b FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS a, CAST(o_orderdate AS DATE) - 7 AS b FROM orders")
sql("fn_date_diff_elapsed", "SELECT event_id, datediff(ts, TIMESTAMP_NTZ '2024-01-01 12:00:00') AS d FROM events", "SELECT event_id, CAST(datesub('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS BIGINT) AS d FROM events")
sql("fn_date_format", "SELECT event_id, date_format(ts, '%d.%m.%Y %H:%i:%s') AS f FROM events", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M:%S') AS f FROM events")
sql("fn_date_make_last", "SELECT n_nationkey, makedate(2024, n_nationkey + 50) AS m, last_day(makedate(2024, n_nationkey + 50)) AS l, maketime(n_nationkey % 24, 5, 9) AS t FROM nation",
    "SELECT n_nationkey, CAST(DATE '2024-01-01' + CAST(n_nationkey + 49 AS INTEGER) AS DATE) AS m, last_day(DATE '2024-01-01' + CAST(n_nationkey + 49 AS INTEGER)) AS l, printf('%02d:05:09', n_nationkey % 24) AS t FROM nation")
sql("fn_date_week_dow", "SELECT o_orderkey, week(o_orderdate) AS w, dayofweek(o_orderdate) AS d, dayofyear(o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(week(o_orderdate) AS BIGINT) AS w, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS d, CAST(dayofyear(o_orderdate) AS BIGINT) AS y FROM orders")
sql("fn_date_text", "SELECT n_nationkey, date(concat('2024-02-', lpad(n_nationkey + 10, 2, '0'))) AS d, date('2024-2-1') AS none FROM nation", "SELECT n_nationkey, try_cast('2024-02-' || (n_nationkey + 10) AS DATE) AS d, CAST(NULL AS DATE) AS none FROM nation")
sql("fn_cast_safe", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice, 'INT') AS i, CAST(l_returnflag AS INT) AS none, convert('3.5', 'FLOAT') AS f, to_int('3.7') AS ti, to_float('2.5') AS tf, to_string(l_linenumber) AS s FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CAST(NULL AS BIGINT) AS none, CAST(3.5 AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS ti, CAST(2.5 AS DOUBLE) AS tf, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem")
sql("fn_coalesce_nullif_if", "SELECT p_partkey, coalesce(nullif(p_size, 1), 0) AS c, ifnull(nullif(p_brand, 'Brand#11'), 'none') AS n, if(p_size > 25, 'L', 'S') AS k, iif(nullif(p_size, 1) > 5, 1, 2) AS j FROM part",
    "SELECT p_partkey, coalesce(nullif(p_size, 1), 0) AS c, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS n, CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END AS k, CASE WHEN p_size = 1 THEN NULL WHEN p_size > 5 THEN 1 ELSE 2 END AS j FROM part")
sql("fn_isnull_typeof", "SELECT p_partkey, isnull(nullif(p_size, 1)) AS a, is_not_null(nullif(p_size, 1)) AS b, typeof(p_partkey) AS t, typeof(p_name) AS u, typeof(p_retailprice) AS v FROM part",
    "SELECT p_partkey, CAST(p_size = 1 AS BIGINT) AS a, CAST(p_size <> 1 AS BIGINT) AS b, 'INT' AS t, 'VARCHAR' AS u, 'FLOAT' AS v FROM part")
sql("fn_blob_hex_base64", "SELECT c_custkey, blob_to_hex(c_name) AS h, blob_to_base64(c_name) AS b, blob_to_hex(blob_from_hex(concat('0x', blob_to_hex(c_name)))) AS back, blob_to_hex(blob_from_base64(blob_to_base64(c_name))) AS again, isnull(blob_from_hex('abc')) AS odd FROM customer",
    "SELECT c_custkey, lower(hex(c_name)) AS h, to_base64(encode(c_name)) AS b, lower(hex(c_name)) AS back, lower(hex(c_name)) AS again, CAST(1 AS BIGINT) AS odd FROM customer")
_PNG, _GIF, _JPEG = "'89504E470D0A1A0A0000000D494844520000000300000004'", "'47494638396105000600'", "'FFD8FFE000104A46494600010100000100010000FFC0001108000A001403'"
sql("fn_image_magic", " UNION ALL ".join(f"SELECT {i} AS n, image_format(image_from_hex({x})) AS f, image_width(image_from_hex({x})) AS w, image_height(image_from_hex({x})) AS h, image_mime(image_from_hex({x})) AS m, image_size(image_from_hex({x})) AS s, image_to_hex(image_from_base64(image_to_base64(image_from_hex({x}), 'datauri'))) AS back FROM region WHERE r_regionkey = 0" for i, x in enumerate((_PNG, _GIF, _JPEG))),
    " UNION ALL ".join(f"SELECT {i} AS n, '{f}' AS f, CAST({w} AS BIGINT) AS w, CAST({h} AS BIGINT) AS h, 'image/{f}' AS m, CAST(length({x}) / 2 AS BIGINT) AS s, lower({x}) AS back FROM region WHERE r_regionkey = 0" for i, (x, f, w, h) in enumerate(((_PNG, "png", 3, 4), (_GIF, "gif", 5, 6), (_JPEG, "jpeg", 20, 10)))))
sql("rand_uuid_rows", "SELECT n_nationkey, rand() AS r, uuid() AS u, now() AS t, current_date() AS d FROM nation", same=False)
