"""SQL bodies of the dialect's functions, and which call names lead to them."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

#: name -> (parameters, result, body). All return NULL for a NULL first argument unless said otherwise.
STRING = {
    "c_trim": ("s STRING", "STRING", r"regexp_replace(s, '(?U)^\\s+|\\s+$', '')"),
    "c_trim_set": ("s STRING, cut STRING", "STRING", "trim(BOTH cut FROM s)"),
    "c_ltrim_set": ("s STRING, cut STRING", "STRING", "trim(LEADING cut FROM s)"),
    "c_rtrim_set": ("s STRING, cut STRING", "STRING", "trim(TRAILING cut FROM s)"),
    "c_substring": ("s STRING, start BIGINT", "STRING", "substring(s, cast(greatest(start, 1) AS INT))"),
    "c_substring_len": ("s STRING, start BIGINT, len BIGINT", "STRING", "substring(s, cast(greatest(start, 1) AS INT), cast(greatest(len, 0) AS INT))"),
    "c_lpad": ("s STRING, n BIGINT, pad STRING", "STRING", "CASE WHEN s IS NULL OR n IS NULL OR pad IS NULL THEN NULL WHEN n <= 0 THEN '' WHEN pad = '' OR char_length(s) >= n THEN right(s, cast(n AS INT)) ELSE right(concat(repeat(pad, cast(n AS INT)), s), cast(n AS INT)) END"),
    "c_rpad": ("s STRING, n BIGINT, pad STRING", "STRING", "CASE WHEN n <= 0 THEN '' WHEN pad = '' THEN left(s, cast(n AS INT)) ELSE rpad(s, cast(n AS INT), pad) END"),
    "c_replace": ("s STRING, old STRING, new STRING", "STRING", "CASE WHEN old = '' THEN concat(new, regexp_replace(s, '(?s)(.)', concat('$1', replace(replace(new, '\\\\', '\\\\\\\\'), '$', '\\\\$')))) ELSE replace(s, old, new) END"),
    "c_space": ("n BIGINT", "STRING", "repeat(' ', cast(greatest(n, 0) AS INT))"),
    "c_strcmp": ("a STRING, b STRING", "BIGINT", "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END"),
    "c_instr": ("s STRING, sub STRING", "BIGINT", "cast(instr(s, sub) AS BIGINT)"),
    "c_byte_length": ("s STRING", "BIGINT", "cast(octet_length(s) AS BIGINT)"),
}
NUMBER = {
    "c_abs": ("x DOUBLE", "DOUBLE", "abs(x)"),
    "c_round": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < 4503599627370496D THEN sign(x) * floor(abs(x) + 0.5D) ELSE x END"),
    "c_round_to": ("x DOUBLE, p INT", "DOUBLE", "CASE WHEN abs(x * power(10D, p)) < 4503599627370496D THEN sign(x) * floor(abs(x * power(10D, p)) + 0.5D) / power(10D, p) ELSE x END"),
    "c_floor": ("x DOUBLE", "BIGINT", "floor(x)"),
    "c_ceil": ("x DOUBLE", "BIGINT", "ceil(x)"),
    "c_sqrt": ("x DOUBLE", "DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    "c_mod": ("a DOUBLE, b DOUBLE", "BIGINT", "try_mod(cast(a AS BIGINT), cast(b AS BIGINT))"),
    "c_sign": ("x DOUBLE", "BIGINT", "cast(sign(x) AS BIGINT)"),
    "c_gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 93), struct(a AS x, b AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x)"),
    "c_lcm": ("a BIGINT, b BIGINT", "BIGINT", "try_divide(a, nullif(aggregate(sequence(1, 93), struct(a AS x, b AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x), 0)) * b"),
    "c_log": ("x DOUBLE", "DOUBLE", "ln(x)"),
    "c_log_of": ("x DOUBLE, base DOUBLE", "DOUBLE", "log(base, x)"),
}
TIME = {
    "c_date": ("s STRING", "DATE", "CASE WHEN s RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' THEN cast(try_to_timestamp(s, 'yyyy-MM-dd') AS DATE) END"),
    "c_datediff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(SECOND, b, a) div 86400"),
    "c_date_add": ("d DATE, n BIGINT", "DATE", "date_add(d, cast(n AS INT))"),
    "c_date_sub": ("d DATE, n BIGINT", "DATE", "date_sub(d, cast(n AS INT))"),
    "c_date_format": ("d TIMESTAMP_NTZ, f STRING", "STRING", "replace(replace(replace(replace(replace(replace(f, '%Y', date_format(d, 'yyyy')), '%m', date_format(d, 'MM')), '%d', date_format(d, 'dd')), '%H', date_format(d, 'HH')), '%i', date_format(d, 'mm')), '%s', date_format(d, 'ss'))"),
    "c_makedate": ("y BIGINT, n BIGINT", "DATE", "date_add(try_to_date(concat(lpad(cast(y AS STRING), 4, '0'), '-01-01')), cast(n - 1 AS INT))"),
    "c_maketime": ("h BIGINT, m BIGINT, s DOUBLE", "STRING", "CASE WHEN h IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL THEN format_string('%02d:%02d:%02d', h, m, cast(s AS BIGINT)) END"),
    "c_current_time": ("", "TIMESTAMP", "current_timestamp()"),
    **{f"c_{n}": ("d TIMESTAMP_NTZ", "BIGINT", f"cast({f}(d) AS BIGINT)") for n, f in {"year": "year", "month": "month", "day": "dayofmonth", "quarter": "quarter", "week": "weekofyear", "dayofweek": "dayofweek", "dayofyear": "dayofyear"}.items()},
    **{f"c_{n}": ("s STRING", "BIGINT", f"CASE WHEN s RLIKE '^[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}$' THEN cast(split_part(s, ':', {i}) AS BIGINT) ELSE cast({n}(try_cast(s AS TIMESTAMP_NTZ)) AS BIGINT) END") for i, n in enumerate(("hour", "minute", "second"), 1)},
}
OTHER = {
    "c_to_string": ("x STRING", "STRING", r"regexp_replace(x, '^(-?[0-9]+)\\.0$', '$1')"),
    "c_to_int": ("x STRING", "BIGINT", "CASE WHEN trim(x) = x THEN try_cast(x AS BIGINT) END"),
    "c_to_float": ("x STRING", "DOUBLE", "try_cast(x AS DOUBLE)"),
    "c_type_name": ("kind STRING", "STRING", "CASE kind WHEN 'bigint' THEN 'INT' WHEN 'int' THEN 'INT' WHEN 'double' THEN 'FLOAT' WHEN 'string' THEN 'VARCHAR' WHEN 'binary' THEN 'BLOB' WHEN 'date' THEN 'DATE' WHEN 'timestamp_ntz' THEN 'DATETIME' WHEN 'timestamp' THEN 'DATETIME' WHEN 'boolean' THEN 'INT' WHEN 'void' THEN 'NULL' ELSE CASE WHEN kind LIKE 'decimal%' THEN 'FLOAT' ELSE upper(kind) END END"),
}
_DIRTY_HEX = r"regexp_replace(regexp_replace(s, '\\s', ''), '^0[xX]', '')"
_DATA_URI = r"translate(regexp_replace(s, '^data:[^,]*,', ''), '-_', '+/')"
_HEAD = "hex(substring(img, 1, 12))"
_FORMAT = f"CASE WHEN img IS NULL THEN NULL WHEN {_HEAD} LIKE '89504E470D0A1A0A%' THEN 'png' WHEN {_HEAD} LIKE 'FFD8FF%' THEN 'jpeg' WHEN {_HEAD} LIKE '474946383761%' OR {_HEAD} LIKE '474946383961%' THEN 'gif' WHEN {_HEAD} LIKE '52494646________57454250' THEN 'webp' WHEN {_HEAD} LIKE '424D%' THEN 'bmp' ELSE 'unknown' END"
_MIME = f"CASE {_FORMAT} WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' WHEN NULL THEN NULL ELSE CASE WHEN img IS NULL THEN NULL ELSE 'application/octet-stream' END END"


def _jpeg(low: int) -> str:
    """Two bytes of the first start-of-frame segment, by walking the segment chain inside one expression."""
    at = "cast(conv(hex(substring(img, s.at + 2, 2)), 16, 10) AS INT)"
    frame = "hex(substring(img, s.at + 1, 1)) RLIKE '^C[0-35-79A-BD-F]$'"
    return f"aggregate(sequence(1, 64), struct(3 AS at, false AS hit), (s, i) -> CASE WHEN s.hit OR hex(substring(img, s.at, 1)) <> 'FF' THEN s WHEN {frame} THEN struct(s.at AS at, true AS hit) ELSE struct(s.at + 2 + {at} AS at, false AS hit) END, s -> CASE WHEN s.hit THEN conv(hex(substring(img, s.at + {low}, 2)), 16, 10) ELSE '0' END)"


def _pixels(png: int, gif: int, jpeg: int) -> str:
    little = f"concat(hex(substring(img, {gif + 1}, 1)), hex(substring(img, {gif}, 1)))"
    return f"cast(CASE {_FORMAT} WHEN 'png' THEN conv(hex(substring(img, {png}, 4)), 16, 10) WHEN 'gif' THEN conv({little}, 16, 10) WHEN 'jpeg' THEN {_jpeg(jpeg)} ELSE CASE WHEN img IS NULL THEN NULL ELSE '0' END END AS BIGINT)"


BLOB = {
    "c_from_base64": ("s STRING", "BINARY", "coalesce(try_to_binary(s, 'base64'), try_to_binary(translate(s, '-_', '+/'), 'base64'))"),
    "c_image_from_base64": ("s STRING", "BINARY", f"try_to_binary({_DATA_URI}, 'base64')"),
    "c_to_base64": ("b BINARY", "STRING", "replace(base64(b), '\r\n', '')"),
    "c_image_to_base64": ("img BINARY, kind STRING", "STRING", f"CASE WHEN lower(kind) = 'datauri' THEN concat('data:', {_MIME}, ';base64,', base64(img)) ELSE base64(img) END"),
    "c_from_hex": ("s STRING", "BINARY", f"CASE WHEN length({_DIRTY_HEX}) % 2 = 0 THEN try_to_binary({_DIRTY_HEX}, 'hex') END"),
    "c_to_hex": ("b BINARY", "STRING", "lower(hex(b))"),
    "c_image_format": ("img BINARY", "STRING", _FORMAT),
    "c_image_mime": ("img BINARY", "STRING", _MIME),
    "c_image_size": ("img BINARY", "BIGINT", "cast(octet_length(img) AS BIGINT)"),
    "c_image_width": ("img BINARY", "BIGINT", _pixels(17, 7, 7)),
    "c_image_height": ("img BINARY", "BIGINT", _pixels(21, 9, 5)),
}
ALL = {**STRING, **NUMBER, **TIME, **OTHER, **BLOB}

#: dialect name -> template by argument count (None: any count); {0}, {1} are arguments, {*} all of them.
RENAMED: dict[str, dict[int | None, str]] = {
    "CONCAT": {None: "concat_ws('', {*})"},
    "LEN": {1: "cast(char_length({0}) AS BIGINT)"}, "LENGTH": {1: "cast(char_length({0}) AS BIGINT)"}, "CHAR_LENGTH": {1: "cast(char_length({0}) AS BIGINT)"}, "CHARACTER_LENGTH": {1: "cast(char_length({0}) AS BIGINT)"},
    "BYTE_LENGTH": {1: "c_byte_length({0})"}, "OCTET_LENGTH": {1: "c_byte_length({0})"},
    "TRIM": {1: "c_trim({0})", 2: "c_trim_set({0}, {1})"}, "LTRIM": {2: "c_ltrim_set({0}, {1})"}, "RTRIM": {2: "c_rtrim_set({0}, {1})"},
    "SUBSTRING": {2: "c_substring({0}, {1})", 3: "c_substring_len({0}, {1}, {2})"}, "SUBSTR": {2: "c_substring({0}, {1})", 3: "c_substring_len({0}, {1}, {2})"},
    "LPAD": {3: "c_lpad({0}, {1}, {2})"}, "RPAD": {3: "c_rpad({0}, {1}, {2})"}, "REPLACE": {3: "c_replace({0}, {1}, {2})"},
    "SPACE": {1: "c_space({0})"}, "STRCMP": {2: "c_strcmp({0}, {1})"}, "INSTR": {2: "c_instr({0}, {1})"},
    "ABS": {1: "c_abs({0})"}, "ROUND": {1: "c_round({0})", 2: "c_round_to({0}, {1})"}, "FLOOR": {1: "c_floor({0})"}, "CEIL": {1: "c_ceil({0})"}, "CEILING": {1: "c_ceil({0})"},
    "SQRT": {1: "c_sqrt({0})"}, "MOD": {2: "c_mod({0}, {1})"}, "SIGN": {1: "c_sign({0})"}, "GCD": {2: "c_gcd({0}, {1})"}, "LCM": {2: "c_lcm({0}, {1})"},
    "LOG": {1: "c_log({0})", 2: "c_log_of({0}, {1})"}, "RANDOM": {0: "rand()"}, "NOW": {0: "localtimestamp()"}, "CURRENT_TIME": {0: "c_current_time()"},
    "DATE": {1: "c_date({0})"}, "DATEDIFF": {2: "c_datediff({0}, {1})"}, "DATE_ADD": {2: "c_date_add({0}, {1})"}, "DATE_SUB": {2: "c_date_sub({0}, {1})"},
    "DATE_FORMAT": {2: "c_date_format({0}, {1})"}, "MAKEDATE": {2: "c_makedate({0}, {1})"}, "MAKETIME": {3: "c_maketime({0}, {1}, {2})"},
    **{n: {1: f"c_{n.lower()}({{0}})"} for n in ("YEAR", "MONTH", "DAY", "QUARTER", "WEEK", "DAYOFWEEK", "DAYOFYEAR", "HOUR", "MINUTE", "SECOND")},
    "TO_STRING": {1: "c_to_string(cast({0} AS STRING))"}, "TO_INT": {1: "c_to_int(cast({0} AS STRING))"}, "TO_FLOAT": {1: "c_to_float(cast({0} AS STRING))"},
    "IFNULL": {None: "coalesce({*})"}, "IF": {3: "CASE cast({0} AS BOOLEAN) WHEN true THEN {1} WHEN false THEN {2} END"}, "IIF": {3: "CASE cast({0} AS BOOLEAN) WHEN true THEN {1} WHEN false THEN {2} END"},
    "ISNULL": {1: "cast(({0}) IS NULL AS BIGINT)"}, "IS_NOT_NULL": {1: "cast(({0}) IS NOT NULL AS BIGINT)"},
    "TYPEOF": {1: "c_type_name(typeof({0}))"},
    "IMAGE_FROM_BASE64": {1: "c_image_from_base64({0})"}, "IMAGE_TO_BASE64": {1: "c_to_base64({0})", 2: "c_image_to_base64({0}, {1})"},
    "IMAGE_WIDTH": {1: "c_image_width({0})"}, "IMAGE_HEIGHT": {1: "c_image_height({0})"}, "IMAGE_FORMAT": {1: "c_image_format({0})"}, "IMAGE_SIZE": {1: "c_image_size({0})"}, "IMAGE_MIME": {1: "c_image_mime({0})"},
    "IMAGE_FROM_HEX": {1: "c_from_hex({0})"}, "IMAGE_TO_HEX": {1: "c_to_hex({0})"}, "BLOB_FROM_BASE64": {1: "c_from_base64({0})"}, "BLOB_TO_BASE64": {1: "c_to_base64({0})"},
    "BLOB_FROM_HEX": {1: "c_from_hex({0})"}, "BLOB_TO_HEX": {1: "c_to_hex({0})"},
}
#: Names whose Spark builtin has the dialect's meaning.
BUILTIN_NAMES = "UPPER LOWER LEFT RIGHT REVERSE REPEAT CONCAT_WS POWER POW LOG10 LOG2 EXP RADIANS DEGREES SIN COS TAN RAND UUID CURRENT_DATE LAST_DAY COALESCE NULLIF COUNT SUM AVG MIN MAX".split()


@contextmanager
def lenient(spark: SparkSession):
    """Statements analysed within give NULL where a value does not fit, instead of an error."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def register(spark: SparkSession) -> None:
    """Create the temporary functions in a session; doing so again is harmless.

    Variable substitution is switched off, since it would rewrite string literals that hold ``${``.
    """
    spark.conf.set("spark.sql.variable.substitute", "false")
    with lenient(spark):
        for name, (parameters, result, body) in ALL.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
