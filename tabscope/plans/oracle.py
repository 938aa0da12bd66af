"""The same results in plain SQL, for comparing with DuckDB."""

from __future__ import annotations

from tabscope.functions.scalars import FLOAT_TEXT, NUMBER_TEXT

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BIN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_GAPS = f"""(SELECT {KEY}, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
    nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem)"""
CUSTOMER_GAPS = """(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
    nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""
ORDER_TEXTS = """(SELECT o_orderkey,
    strftime(o_orderdate, '%Y-%m-%d') AS iso_day,
    strftime(o_orderdate, '%m/%d/%Y') AS us_day,
    strftime(o_orderdate, '%d %b %Y') AS long_day,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS some_day,
    '$ ' || o_custkey || ' net' AS lettered,
    '$ ' || o_custkey AS amount,
    CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'True'
      WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN o_orderpriority END AS mixed
    FROM orders)"""
FILE_RECORDS = """(SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(o_custkey AS VARCHAR) AS project_id,
    'f' || o_orderkey || '.csv' AS filename, o_orderpriority || '_' || o_orderkey AS file,
    CASE WHEN o_orderstatus = 'O' THEN 'csv' ELSE 'text' END AS type, o_orderdate AS created_at,
    o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AS is_deleted, o_orderkey % 13 = 0 AS is_sample
    FROM orders)"""
PLACES = """(SELECT lower(n_name) AS place, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
COUNTRIES = "(SELECT lower(n_name) AS name FROM nation WHERE n_regionkey <> 0)"


def _per(columns: list[str], select: str, source: str) -> str:
    """One SELECT per column, with ``{c}`` for its name."""
    return "\nUNION ALL\n".join(f"SELECT {select.format(c=c)} FROM {source}" for c in columns)


def _message(aggregation: str, field: str) -> str:
    return f"upper(left('{aggregation}', 1)) || lower(substr('{aggregation} of ' || {field}, 2))"


def _number_cards(aggregation: str, source: str, fields: list[str]) -> str:
    value = {
        "sum": "coalesce(sum({c}), 0)",
        "average": "avg({c})",
        "count": "CAST(count({c}) AS DOUBLE)",
        "minimum": "CAST(min({c}) AS DOUBLE)",
        "maximum": "CAST(max({c}) AS DOUBLE)",
        "std_deviation": "stddev_samp({c})",
        "variance": "var_samp({c})",
        "median": "quantile_cont({c}, 0.5)",
        "count_distinct": "CAST(count(DISTINCT {c}) AS DOUBLE)",
    }[aggregation]
    select = (
        f"'{{c}}' AS field, '{aggregation}' AS aggregation, round(CAST({value} AS DOUBLE), 4) AS value, "
        + _message(aggregation, "'{c}'")
        + " AS message"
    )
    return _per(fields, select, source)


def _category_cards(aggregation: str) -> str:
    value = {
        "first": "arg_min({c}, o_orderkey)",
        "last": "arg_max({c}, o_orderkey)",
        "count": "CAST(count(*) AS VARCHAR)",
        "count_distinct": "CAST(count(DISTINCT {c}) AS VARCHAR)",
    }[aggregation]
    select = (
        f"'{{c}}' AS field, '{aggregation}' AS aggregation, {value} AS value, "
        + _message(aggregation, "'{c}'")
        + " AS message"
    )
    return _per(["o_orderpriority", "o_orderstatus"], select, "orders")


def _group_sum(source: str, key: str, value: str, tail: str = "LIMIT 10") -> str:
    return f"""SELECT {key}, round(coalesce(sum({value}), 0), 2) AS "sum" FROM {source}
    WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY {key} {tail}"""


def _top_counts(source: str, column: str) -> str:
    return f"""SELECT {column}, count(*) AS "count" FROM {source} WHERE {column} IS NOT NULL
    GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 10"""


def _shares(source: str, column: str) -> str:
    return f"""SELECT {column}, "count", round("count" * 100.0 / sum("count") OVER (), 1)::DOUBLE AS percent
    FROM ({_top_counts(source, column)})"""


# --- outliers -------------------------------------------------------------------------------


def _quartiles(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
    quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
    CAST(avg({c}) AS DOUBLE) AS mean, CAST(stddev_pop({c}) AS DOUBLE) AS deviation,
    CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n FROM {source}"""


def _outliers(columns: list[str], source: str) -> str:
    parts = [
        f"""SELECT DISTINCT s."column", CAST({c} AS DOUBLE) AS value FROM {source} t, ({_quartiles(c, source)}) s
    WHERE {_flag(c)}"""
        for c in columns
    ]
    return "\nUNION ALL\n".join(parts)


def _flag(c: str) -> str:
    return f"""(CAST({c} AS DOUBLE) < s.q1 - 1.5 * (s.q3 - s.q1) OR CAST({c} AS DOUBLE) > s.q3 + 1.5 * (s.q3 - s.q1)
    OR (s.deviation > 0 AND abs((CAST({c} AS DOUBLE) - s.mean) / s.deviation) > 3))"""


# --- histograms -----------------------------------------------------------------------------

_BY_WIDTH = "ceil((hi - lo) / CASE WHEN ({width}) = 0 THEN 1.0 ELSE ({width}) END)"
_RULES = {
    "fd": _BY_WIDTH.format(width="2 * (q3 - q1) / cbrt(n)"),
    "sturges": "ceil(log2(n) + 1)",
    "rice": "ceil(2 * cbrt(n))",
    "sqrt": "ceil(sqrt(n))",
    "doane": """floor(1 + log2(n) + log2(1 + abs(sqrt(n::DOUBLE * (n - 1)) / (n - 2) * g1)
        / sqrt((6.0 * (n - 2)) / ((n + 1)::DOUBLE * (n + 3)))))""",
    "scott": _BY_WIDTH.format(width="3.5 * deviation / cbrt(n)"),
    "custom": "10",
}


def _layout(columns: list[str], source: str, method: str) -> str:
    parts = []
    for c in columns:
        skew = f"""(SELECT (avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5)) FROM {source},
        (SELECT avg({c}) AS m FROM {source}))"""
        parts.append(f"SELECT q.*, {skew if method == 'doane' else 'NULL'} AS g1 FROM ({_quartiles(c, source)}) q")
    union = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, greatest(CAST({_RULES[method]} AS BIGINT), 1) AS bins FROM ({union})"""


def _histogram(columns: list[str], source: str, layout: str, extra: str = "", digits: int = 6) -> str:
    values = _per(columns, "'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value", source)
    lo, hi = "CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END", "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END"
    return f"""WITH layout AS ({layout}),
    wide AS (SELECT * EXCLUDE (lo, hi), {lo} AS lo, {hi} AS hi FROM layout),
    slots AS (SELECT *, unnest(range(0, bins)) AS i FROM wide),
    edges AS (SELECT *, i * ((hi - lo) / bins) + lo AS l,
      CASE WHEN i + 1 >= bins THEN hi ELSE (i + 1) * ((hi - lo) / bins) + lo END AS r FROM slots),
    vals AS ({values}),
    distinct_vals AS (SELECT "column", value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL),
    counted AS (SELECT e."column", e.i, sum(v.n) AS n FROM edges e JOIN distinct_vals v
      ON e."column" = v."column" AND v.value >= e.l AND (v.value < e.r OR (e.i = e.bins - 1 AND v.value <= e.r))
      GROUP BY ALL)
    SELECT e."column", e.i AS "index", round(e.l, {digits}) AS left_value, round(e.r, {digits}) AS right_value,
      CAST(coalesce(c.n, 0) AS BIGINT) AS "count"{extra}
    FROM edges e LEFT JOIN counted c ON e."column" = c."column" AND e.i = c.i"""


LABEL = """, printf('%.2f - %.2f', e.l, e.r) AS label"""
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _iso(expression: str) -> str:
    return f"""CASE WHEN epoch_us({expression}) % 1000000 = 0 THEN strftime({expression}, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime({expression}, '%Y-%m-%dT%H:%M:%S.%f') END"""


def _mean_moment(column: str) -> str:
    return f"make_timestamp(CAST(sum(CAST(epoch_us({column}) AS HUGEINT)) // count({column}) AS BIGINT))"


# --- profile --------------------------------------------------------------------------------


def _profile_table() -> str:
    parts = []
    columns = [
        ("l_orderkey", "bigint"),
        ("l_partkey", "bigint"),
        ("l_suppkey", "bigint"),
        ("l_linenumber", "int"),
        ("l_quantity", "double"),
        ("l_extendedprice", "double"),
        ("l_discount", "double"),
        ("l_tax", "double"),
        ("l_returnflag", "string"),
        ("l_linestatus", "string"),
        ("l_shipdate", "timestamp_ntz"),
    ]
    for position, (c, dtype) in enumerate(columns):
        head = f"""SELECT {position} AS position, '{c}' AS "column", '{dtype}' AS original_type"""
        counts = f"count(*) AS total_count, count({c}) AS non_null_count, count({c}) AS valid_count"
        if dtype == "string":
            top = f"SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
            parts.append(
                f"""{head}, 'STRING' AS type, 'STRING' AS extended_type, {counts}, NULL::BIGINT AS finite_count,
    NULL::DOUBLE AS mean, NULL::DOUBLE AS standard_deviation, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum,
    NULL AS mean_date, NULL AS minimum_date, NULL AS maximum_date,
    NULL::DOUBLE AS q1, NULL::DOUBLE AS q2, NULL::DOUBLE AS q3, NULL::BIGINT AS histogram_bins,
    (SELECT v FROM ({top})) AS most_common_value, (SELECT n FROM ({top})) AS most_common_value_count,
    count(DISTINCT {c}) AS unique_value_count FROM lineitem"""
            )
        elif dtype == "timestamp_ntz":
            parts.append(
                f"""{head}, 'DATE_TIME' AS type, 'DATE_TIME' AS extended_type, {counts}, NULL, NULL, NULL, NULL, NULL,
    {_iso(_mean_moment(c))}, {_iso(f"min({c})")}, {_iso(f"max({c})")}, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM lineitem"""
            )
        else:
            extended = "FLOAT" if dtype == "double" else "INTEGER"
            width = f"(2 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) / cbrt(count(*)))"
            bins = f"greatest(CAST(ceil((max({c}) - min({c})) / CASE WHEN {width} = 0 THEN 1 ELSE {width} END) AS BIGINT), 1)"
            parts.append(
                f"""{head}, 'NUMERIC' AS type, '{extended}' AS extended_type, {counts}, count({c}),
    round(avg({c}), 4), round(stddev_pop({c}), 4), min({c})::DOUBLE, max({c})::DOUBLE, NULL, NULL, NULL,
    round(quantile_cont({c}::DOUBLE, 0.25), 4), round(quantile_cont({c}::DOUBLE, 0.5), 4),
    round(quantile_cont({c}::DOUBLE, 0.75), 4), {bins}, NULL, NULL, NULL FROM lineitem"""
            )
    # The first branch names the columns, so a text column leads.
    parts.sort(key=lambda sql: "'STRING' AS type" not in sql)
    return "\nUNION ALL\n".join(parts)


def _profile_documents() -> str:
    def number(position: int, c: str, extended: str) -> str:
        width = f"(2 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) / cbrt(count(*)))"
        return f"""SELECT '{c}' AS name, {position} AS position, '{extended}' AS extended_type,
    count({c}) AS valid_count, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
    CAST(ceil((max({c}) - min({c})) / {width}) AS INTEGER) AS buckets, count({c}) AS binned,
    NULL AS most_common_value, NULL::BIGINT AS unique_value_count, NULL AS earliest, NULL::BIGINT AS dated
    FROM orders"""

    def text(position: int, c: str) -> str:
        top = f"SELECT {c} AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
        return f"""SELECT '{c}', {position}, 'STRING', count({c}), NULL, NULL, NULL, ({top}), count(DISTINCT {c}),
    NULL, NULL FROM orders"""

    date = f"""SELECT 'o_orderdate', 4, 'DATE_TIME', count(*), NULL, NULL, NULL, NULL, NULL,
    {_iso("min(o_orderdate)")}, count(*) FROM orders"""
    return "\nUNION ALL\n".join(
        [
            number(0, "o_orderkey", "INTEGER"),
            number(1, "o_custkey", "INTEGER"),
            text(2, "o_orderstatus"),
            number(3, "o_totalprice", "FLOAT"),
            date,
            text(5, "o_orderpriority"),
        ]
    )


def _column_analysis() -> str:
    parts = []
    orders = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    for position, c in enumerate(orders):
        parts.append(
            f"""SELECT {position} AS position, '{c}' AS "column", count(*) AS total_values,
    count(DISTINCT {c}) AS unique_values,
    round(count(DISTINCT {c}) * 100.0 / count(*), 2)::DOUBLE AS unique_percentage,
    (SELECT string_agg(CAST({c} AS VARCHAR), ';' ORDER BY o_orderkey)
     FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)) AS sample_values, FALSE AS is_nullable FROM orders"""
        )
    return "\nUNION ALL\n".join(parts)


def _type_mix() -> str:
    parts = []
    for c in ["o_orderkey", "iso_day", "us_day", "long_day", "some_day", "lettered", "amount", "mixed"]:
        text = f"coalesce(CAST({c} AS VARCHAR), 'None')"
        numeric = f"regexp_matches({text}, '{FLOAT_TEXT}')"
        truth = f"(NOT {numeric} AND lower({text}) IN ('true', 'false', '0', '1'))"
        shapes = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})$"
        date = f"(NOT {numeric} AND NOT {truth} AND regexp_matches({text}, '{shapes}'))"
        shares = {
            "numeric": numeric,
            "boolean": truth,
            "date": date,
            "string": f"NOT ({numeric} OR {truth} OR {date})",
        }
        select = ", ".join(
            f'round(count(*) FILTER ({test}) * 100.0 / count(*), 2)::DOUBLE AS "{name}"' for name, test in shares.items()
        )
        parts.append(f"""SELECT '{c}' AS "column", {select} FROM {ORDER_TEXTS}""")
    return "\nUNION ALL\n".join(parts)


def _text_profile(column: str) -> str:
    counts = f"(SELECT {column} AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"
    return f"""SELECT '{column}' AS "column", (SELECT first(v ORDER BY n DESC, v) FROM {counts}) AS most_common_value,
    (SELECT max(n) FROM {counts}) AS most_common_value_count,
    (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM {counts}) AS counts,
    count(DISTINCT {column}) AS unique_value_count FROM part"""


def _top_values(column: str) -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column",
    CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS position,
    {column} AS value, count(*) AS "count" FROM events GROUP BY {column}) WHERE position <= 5"""


def _top_long(source: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS position,
        {c} AS text, count(*) AS "count" FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns
    ]
    return f"""SELECT "column", position, sha256(text) AS value, "count" FROM ({" UNION ALL ".join(parts)})
        WHERE position <= 5"""


def _stream_profile(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS finite_count, round(sum({column}::DOUBLE), 2) AS total,
    round(sum({column}::DOUBLE * {column}), 2) AS total_squares, round(avg({column}::DOUBLE), 2) AS mean,
    round(stddev_pop({column}::DOUBLE), 2) AS standard_deviation, min({column})::DOUBLE AS minimum,
    max({column})::DOUBLE AS maximum FROM events"""


def _copies(source: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT {columns}, row_number() OVER (PARTITION BY {columns}) AS copy
    FROM {source}) WHERE copy > 1"""


def _tied(wanted: str) -> str:
    columns = "k, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
    order = "k NULLS FIRST, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS copy
        FROM (SELECT nullif(l_linenumber, 1) AS k, * FROM lineitem)) WHERE {wanted}"""


def _quality_counts() -> str:
    source = "(SELECT nullif(event_type, 'view') AS event_type, value, user_id FROM events)"
    return f"""SELECT 'missing_rows' AS measure, '' AS "column",
      count(*) FILTER (event_type IS NULL OR value IS NULL OR user_id IS NULL) AS total FROM {source}
    UNION ALL SELECT 'duplicate_rows', '', (SELECT count(*) FROM {source})
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))
    UNION ALL SELECT 'outliers', c, (SELECT count(*) FROM ({_outliers(["value", "user_id"], "events")}) o
      WHERE o."column" = c) FROM (VALUES ('value'), ('user_id')) t(c)"""


def _quality_report() -> str:
    source = f"(SELECT l_returnflag, l_linenumber, l_tax FROM {LINEITEM_GAPS})"
    return f"""SELECT 'missing_rows' AS measure, '' AS "column", CAST(count(*) FILTER
      (l_returnflag IS NULL OR l_tax IS NULL) AS VARCHAR) AS value FROM {source}
    UNION ALL SELECT 'duplicate_rows', '', CAST((SELECT count(*) FROM {source})
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS VARCHAR)
    UNION ALL SELECT 'outliers', c, CAST((SELECT count(*) FROM ({_outliers(["l_linenumber", "l_tax"], source)}) o
      WHERE o."column" = c) AS VARCHAR) FROM (VALUES ('l_linenumber'), ('l_tax')) t(c)
    UNION ALL SELECT 'data_type', c, d
      FROM (VALUES ('l_returnflag', 'string'), ('l_linenumber', 'int'), ('l_tax', 'double')) t(c, d)"""


def _quality_counts_whole(source: str, columns: list[str], numbers: list[str]) -> str:
    missing = " OR ".join(f"{c} IS NULL" for c in columns)
    listed = ", ".join(f"('{c}')" for c in numbers)
    return f"""SELECT 'missing_rows' AS measure, '' AS "column", count(*) FILTER ({missing}) AS total FROM {source}
    UNION ALL SELECT 'duplicate_rows', '', (SELECT count(*) FROM {source})
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))
    UNION ALL SELECT 'outliers', c, (SELECT count(*) FROM ({_outliers(numbers, source)}) o
      WHERE o."column" = c) FROM (VALUES {listed}) t(c)"""


def _quality_report_whole() -> str:
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"}
    types |= {"o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    counts = _quality_counts_whole("orders", list(types), ["o_orderkey", "o_custkey", "o_totalprice"])
    listed = ", ".join(f"('{c}', '{t}')" for c, t in types.items())
    return f"""SELECT measure, "column", CAST(total AS VARCHAR) AS value FROM ({counts})
    UNION ALL SELECT 'data_type', c, d FROM (VALUES {listed}) t(c, d)"""


def _delete_row_outlier(source: str = "events", numbers: tuple[str, ...] = ("event_id", "user_id", "value")) -> str:
    limits = "\nUNION ALL\n".join(_quartiles(c, source) for c in numbers)
    tests = " OR ".join(
        f"""EXISTS (SELECT 1 FROM limits s WHERE s."column" = '{c}' AND {_flag(f"e.{c}")})""" for c in numbers
    )
    kept = "event_id, user_id, value" if source == "events" else "*"
    return f"""WITH limits AS ({limits}) SELECT {kept} FROM {source} e WHERE NOT ({tests})"""


def _cleanse_whole() -> str:
    columns = f"{KEY}, l_discount, l_tax"
    source = f"""(SELECT DISTINCT {columns} FROM {LINEITEM_GAPS}
        WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL)"""
    return _delete_row_outlier(source, (*NUMBERS[:3], "l_linenumber", "l_extendedprice", "l_discount", "l_tax"))


def _mode(column: str, source: str) -> str:
    return f"""(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}
    ORDER BY count(*) DESC, {column} LIMIT 1)"""


def _column_mode(column: str, slot: str) -> str:
    slots = {
        "whole": "NULL::BIGINT",
        "number": "NULL::DOUBLE",
        "text": "NULL::VARCHAR",
        slot: {"whole": f"{column}::BIGINT", "number": f"{column}::DOUBLE", "text": column}[slot],
    }
    listed = ", ".join(f'{slots[s]} AS "{s}"' for s in ("whole", "number", "text"))
    return f"""SELECT * FROM (SELECT '{column}' AS "column", count(*) AS n, {listed} FROM part GROUP BY {column}
    ORDER BY count(*) DESC, {column} LIMIT 1)"""


def _kind(path: str) -> str:
    name = "regexp_matches(lower({0}), '[^/.][^/]*\\.({1})$')"
    return f"""CASE WHEN {name.format(path, "csv")} THEN 'csv' WHEN {name.format(path, "txt")} THEN 'text'
    WHEN {name.format(path, "jpg|jpeg|png")} THEN 'image' WHEN {name.format(path, "pdf")} THEN 'pdf'
    ELSE 'unknown' END"""


def oracle() -> dict[str, str]:
    """SQL by query name."""
    sql = {
        "nullify_nonfinite": f"SELECT {KEY}, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem",
        "nullify_nan": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer",
        "strip_numeric": """SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE) AS number
            FROM events""",
        "coerce_numeric": f"""SELECT o_orderkey, CASE WHEN regexp_matches(mixed, '{NUMBER_TEXT}')
            THEN TRY_CAST(trim(mixed) AS DOUBLE) END AS number, NULL::DOUBLE AS unread FROM {ORDER_TEXTS}""",
        "classify_extension": f"""SELECT page_id, {_kind("url")} AS kind,
            {_kind("url || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.tar.jpeg' END")} AS kind_of_copy FROM pages""",
        "normalize_key": "SELECT c_custkey, lower(c_name) AS key FROM customer",
        "is_date_text": f"""SELECT o_orderkey, some_day <> 'unknown' AS some_day,
            regexp_matches(mixed, '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') AS mixed FROM {ORDER_TEXTS}""",
        "project_pair": f"SELECT l_discount, l_tax FROM {LINEITEM_GAPS} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL",
        "column_roles": _per(
            ["o_orderkey", "iso_day", "us_day", "long_day", "some_day", "lettered", "amount", "mixed"],
            """(SELECT list_position(['o_orderkey', 'iso_day', 'us_day', 'long_day', 'some_day', 'lettered', 'amount',
               'mixed'], '{c}') - 1)::INTEGER AS position, '{c}' AS "column",
            CASE WHEN '{c}' = 'o_orderkey' OR (bool_or(regexp_matches(CAST({c} AS VARCHAR), '\\d'))
              AND NOT regexp_matches(coalesce(arg_min_null(CAST({c} AS VARCHAR), o_orderkey), 'None'), '[A-Za-z]'))
            THEN 'numeric' ELSE 'object' END AS role""",
            ORDER_TEXTS,
        ),
        "role_counts": """SELECT 6 AS count_header, count(*) AS count_records,
            'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS all_columns,
            'o_orderkey,o_custkey,o_totalprice,o_orderdate' AS numeric_columns,
            'o_orderstatus,o_orderpriority' AS object_columns FROM orders""",
        "header_summary": """SELECT 8 AS count_header, count(*) AS count_records,
            'o_orderkey,iso_day,us_day,long_day,some_day,lettered,amount,mixed' AS header,
            'o_orderkey,iso_day,us_day,amount,mixed' AS header_numeric,
            'long_day,some_day,lettered' AS object_columns, 'long_day' AS header_date FROM orders""",
        "date_columns": "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", '{pattern}' AS date_format FROM {ORDER_TEXTS}
            HAVING bool_and(try_strptime({c}, '{directive}') IS NOT NULL)"""
            for c, pattern, directive in (
                ("iso_day", "yyyy-M-d", "%Y-%m-%d"),
                ("us_day", "M/d/yyyy", "%m/%d/%Y"),
                ("long_day", "d MMM yyyy", "%d %b %Y"),
                ("some_day", "yyyy-M-d", "%Y-%m-%d"),
                ("lettered", "yyyy-M-d", "%Y-%m-%d"),
                ("amount", "yyyy-M-d", "%Y-%m-%d"),
                ("mixed", "d-M-yyyy", "%d-%m-%Y"),
            )
        ),
        "typed_by_role": f"""SELECT o_orderkey,
            TRY_CAST(regexp_replace(amount, '[^0-9.]', '', 'g') AS DOUBLE) AS amount, lettered FROM {ORDER_TEXTS}""",
        "parse_dates": f"""SELECT o_orderkey, iso_day, strftime(strptime(us_day, '%m/%d/%Y'), '%Y-%m-%d') AS us_day,
            strftime(strptime(long_day, '%d %b %Y'), '%Y-%m-%d') AS long_day FROM {ORDER_TEXTS}""",
        "dataset_summary": """SELECT count(*) AS total_rows, 11 AS total_columns, 'parquet' AS file_type,
            NULL::BIGINT AS file_size FROM lineitem""",
        "missing_rows": f"""SELECT * FROM {LINEITEM_GAPS}
            WHERE l_discount IS NULL OR l_tax IS NULL OR l_returnflag IS NULL""",
        "delete_missing_row": f"""SELECT * FROM {LINEITEM_GAPS}
            WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL""",
        "drop_missing": f"SELECT * FROM {LINEITEM_GAPS} WHERE l_tax IS NOT NULL",
        "duplicate_rows": _copies("documents", "text, lang"),
        "duplicate_rows_many_copies": _copies(LINEITEM_GAPS, "l_returnflag, l_linenumber, l_tax"),
        "duplicate_rows_by_text": """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER
            (PARTITION BY text ORDER BY doc_id) AS copy FROM documents) WHERE copy > 1""",
        "delete_duplicate_row": f"SELECT DISTINCT l_returnflag, l_linenumber, l_tax FROM {LINEITEM_GAPS}",
        "delete_duplicate_row_by_text": """SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER
            (PARTITION BY text ORDER BY doc_id) AS copy FROM documents) WHERE copy = 1""",
        "duplicate_rows_tied_key": _tied("copy > 1"),
        "delete_duplicate_row_tied_key": _tied("copy = 1"),
        "delete_duplicate_row_whole": "SELECT DISTINCT * FROM lineitem",
        "duplicate_rows_whole": """SELECT * FROM lineitem WHERE l_quantity < 10
            UNION ALL SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY lineitem) AS copy FROM lineitem)
            WHERE copy > 1""",
        "group_sum_nan": """SELECT l_discount, sum(l_quantity) AS sum FROM lineitem WHERE l_discount <> 0.05 GROUP BY 1""",
        "value_counts_nan": """SELECT l_discount, count(*) AS "count" FROM lineitem WHERE l_discount <> 0.05 GROUP BY 1""",
        "kpi_distinct_nan": """SELECT 'l_discount' AS field,
            CAST(count(DISTINCT nullif(l_discount, 0.05)) AS VARCHAR) AS value FROM lineitem
            UNION ALL SELECT 'l_returnflag', CAST(count(DISTINCT l_returnflag) AS VARCHAR) FROM lineitem
            UNION ALL SELECT 'l_discount', CAST(count(DISTINCT nullif(l_discount, 0.05)) AS VARCHAR) FROM lineitem""",
        "map_summary_nan": """SELECT min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, count(*) AS total_countries
            FROM customer WHERE c_acctbal <= 5000""",
        "share_series_all": """SELECT p_brand, count(*) AS "count",
            round(count(*) * 100.0 / (SELECT count(*) FROM part), 1) AS percent FROM part GROUP BY 1""",
        "radar_all": """SELECT o_custkey, round(s, 6) AS sum, round(s / max(s) OVER (), 6) AS scaled
            FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)""",
        "date_flags": f"""SELECT 'iso_day' AS "column", count(try_strptime(iso_day, '%Y-%m-%d')) = count(iso_day) AS is_date
            FROM {ORDER_TEXTS}
            UNION ALL SELECT 'us_day', count(try_strptime(us_day, '%m/%d/%Y')) = count(us_day) FROM {ORDER_TEXTS}
            UNION ALL SELECT 'some_day', count(try_strptime(some_day, '%Y-%m-%d')) = count(some_day) FROM {ORDER_TEXTS}
            UNION ALL SELECT 'lettered', count(try_strptime(lettered, '%Y-%m-%d')) = count(lettered) FROM {ORDER_TEXTS}""",
        "page_info_large": """SELECT count(*) AS "count", 1 AS total_pages, 1 AS page, 3000000 AS size, FALSE AS next,
            FALSE AS previous FROM lineitem""",
        "page_slice_large": "SELECT * FROM customer",
        "csv_line_breaks": """SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '",;' || c_nationkey || chr(10) AS note,
            c_acctbal FROM customer""",
        "scraped_files": """SELECT 'p-' || o_orderkey || ',0,0,' || o_orderpriority AS value FROM orders
            UNION ALL SELECT 'p-' || o_orderkey || ',1,0,"a, b",c,' || o_orderkey FROM orders
            UNION ALL SELECT 'p-' || o_orderkey || ',1,1,short,,' FROM orders""",
        "json_document": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "stored_profile_by_id": """SELECT 'orders' AS file_id, 'o_custkey' AS "column", count(*) AS total_count FROM orders""",
        "iqr_bounds": "\nUNION ALL\n".join(
            f"""SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
            round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM ({_quartiles(c, "lineitem")})"""
            for c in MEASURES
        ),
        "iqr_outliers": f"""SELECT event_id, value FROM events, ({_quartiles("value", "events")}) s
            WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
        "zscore_outliers": f"""SELECT event_id, value FROM events, ({_quartiles("value", "events")}) s
            WHERE abs((value - mean) / deviation) > 3""",
        "outlier_values": _outliers(["event_id", "user_id", "value"], "events"),
        "quality_counts": _quality_counts(),
        "quality_report": _quality_report(),
        "delete_row_outlier": _delete_row_outlier(),
        "delete_row_outlier_whole": _delete_row_outlier("lineitem", tuple(NUMBERS)),
        "quality_counts_whole": _quality_counts_whole(
            "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity < 10)",
            [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"],
            NUMBERS,
        ),
        "quality_report_whole": _quality_report_whole(),
        "cleanse_whole": _cleanse_whole(),
        "impute_by_mean": f"""SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {CUSTOMER_GAPS})), 6)
            AS c_acctbal, c_mktsegment FROM {CUSTOMER_GAPS}""",
        "impute_by_mode": f"""SELECT {KEY}, coalesce(l_discount, {_mode("l_discount", LINEITEM_GAPS)}) AS l_discount,
            coalesce(l_tax, {_mode("l_tax", LINEITEM_GAPS)}) AS l_tax,
            coalesce(l_returnflag, {_mode("l_returnflag", LINEITEM_GAPS)}) AS l_returnflag FROM {LINEITEM_GAPS}""",
        "column_modes": "\nUNION ALL\n".join(
            [_column_mode("p_brand", "text"), _column_mode("p_size", "whole"), _column_mode("p_retailprice", "number")]
        ),
        "convert_types": f"""SELECT o_orderkey::DOUBLE AS o_orderkey, TRY_CAST(mixed AS BIGINT) AS mixed,
            CAST(iso_day AS DATE) AS iso_day FROM {ORDER_TEXTS}""",
        "remove_missing_cell": f"""SELECT c_custkey, 'c_acctbal' AS "column", CAST(c_acctbal AS VARCHAR) AS value
            FROM {CUSTOMER_GAPS} WHERE c_acctbal IS NOT NULL
            UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM {CUSTOMER_GAPS} WHERE c_mktsegment IS NOT NULL""",
        "cleanse": f"""SELECT DISTINCT l_returnflag, l_linenumber, l_tax, l_discount FROM {LINEITEM_GAPS}
            WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL""",
        "kpi_cards": _number_cards("average", "lineitem", MEASURES),
        "cards_of_raw_text": f"""SELECT 'amount' AS field, 'sum' AS aggregation, round(sum(o_custkey)::DOUBLE, 4) AS value,
            'Sum of amount' AS message FROM orders UNION ALL SELECT 'lettered', 'sum', 0.0, 'Sum of lettered'""",
        "group_sum": _group_sum("lineitem", "l_returnflag", "l_extendedprice"),
        "group_sum_by_value": """SELECT l_partkey, round(sum(l_quantity), 2) AS "sum" FROM lineitem GROUP BY l_partkey
            ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 25""",
        "group_sum_all": _group_sum(
            "events", "user_id", "TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE)", ""
        ),
        "value_counts": _top_counts("events", "user_id"),
        "chart_line": _group_sum("(SELECT strftime(ts, '%Y-%m-%d') AS day, value FROM events)", "day", "value"),
        "chart_scatter": _group_sum("part", "p_size", "p_retailprice"),
        "chart_bar": _group_sum("lineitem", "l_returnflag", "l_quantity"),
        "chart_column": _group_sum("orders", "o_orderpriority", "o_totalprice"),
        "chart_pie": _shares("events", "event_type"),
        "chart_donut": _shares("part", "p_brand"),
        "chart_area": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
        "chart_heatmap": f"""SELECT l_discount, l_tax FROM {LINEITEM_GAPS} WHERE l_discount IS NOT NULL
            AND l_tax IS NOT NULL ORDER BY {KEY} LIMIT 16""",
        "chart_bubble": """WITH s AS (SELECT p_brand, sum(p_size)::DOUBLE AS v FROM part GROUP BY p_brand
            ORDER BY p_brand LIMIT 10), m AS (SELECT min(v) AS lo, max(v) AS hi FROM s)
            SELECT p_brand, round(v, 6) AS "sum", greatest(least(v * 10, 2000.0), 50.0)::DOUBLE AS size,
            round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS colour, round(lo * 0.9::DOUBLE, 6) AS y_low,
            round(hi * 1.1::DOUBLE, 6) AS y_high FROM s, m""",
        "chart_waterfall": """WITH s AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY o_orderpriority
            ORDER BY o_orderpriority LIMIT 10), r AS (SELECT o_orderpriority, v,
            CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS position,
            sum(v) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS e FROM s)
            SELECT position, o_orderpriority, 'relative' AS measure, round(v, 2) AS value, round(e - v, 2) AS start,
            round(e, 2) AS "end" FROM r
            UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), 'total', 'total', round(sum(v), 2), 0.0, round(sum(v), 2)
            FROM s""",
        "waterfall_all_groups": """WITH s AS (SELECT l_partkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey),
            r AS (SELECT l_partkey, v, CAST(row_number() OVER (ORDER BY l_partkey) AS INTEGER) AS position,
            sum(v) OVER (ORDER BY l_partkey ROWS UNBOUNDED PRECEDING) AS e FROM s)
            SELECT position, CAST(l_partkey AS VARCHAR) AS l_partkey, 'relative' AS measure, round(v, 2) AS value,
            round(e - v, 2) AS start, round(e, 2) AS "end" FROM r
            UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), 'total', 'total', round(sum(v), 2), 0.0, round(sum(v), 2)
            FROM s""",
        "chart_radar": """WITH s AS (SELECT p_size, sum(p_retailprice) AS v FROM part GROUP BY p_size ORDER BY p_size LIMIT 10)
            SELECT p_size, round(v, 2) AS "sum", round(v / (SELECT max(v) FROM s), 6) AS scaled FROM s""",
        "chart_histogram": _histogram(
            ["l_discount"],
            "lineitem",
            """SELECT 'l_discount' AS "column", min(l_discount) AS lo, max(l_discount) AS hi, 15 AS bins FROM lineitem""",
            digits=9,
        ).replace('SELECT e."column", e.i AS "index"', 'SELECT e.i AS "index"'),
        "chart_of_raw_text": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown'
            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS some_day, sum(o_custkey)::DOUBLE AS "sum" FROM orders
            GROUP BY 1 ORDER BY 1 LIMIT 10""",
        "map_join": f"""SELECT p.place AS "Country", c_acctbal FROM {PLACES} p JOIN {COUNTRIES} c ON p.place = c.name""",
        "map_summary": f"""SELECT min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, count(*) AS total_countries
            FROM {PLACES} p JOIN {COUNTRIES} c ON p.place = c.name""",
        "unmatched_places": f"""SELECT place AS "Country", count(*) AS "rows" FROM {PLACES}
            WHERE place NOT IN (SELECT name FROM {COUNTRIES}) GROUP BY place""",
        "histogram_fd": _histogram(BIN_COLUMNS, "lineitem", _layout(BIN_COLUMNS, "lineitem", "fd"), LABEL),
        "histogram_sturges": _histogram(["value"], "events", _layout(["value"], "events", "sturges"), LABEL),
        "histogram_far_value": "SELECT count(*) AS n, 1e13::DOUBLE AS hi, TRUE AS many FROM orders",
        "profile_document_buckets": _histogram(ORDER_NUMBERS, "orders", _layout(ORDER_NUMBERS, "orders", "fd")),
        "profile_histograms": _histogram(
            BIN_COLUMNS,
            "lineitem",
            _layout(BIN_COLUMNS, "lineitem", "fd"),
            ", e.n AS n, round(e.q1, 6) AS q1, round(e.q2, 6) AS q2, round(e.q3, 6) AS q3",
        ),
        "datetime_histogram": f"""SELECT 'o_orderdate' AS "column", "index",
            {_iso("make_timestamp(CAST(round(left_value * 1000000) AS BIGINT))")} AS left_value,
            {_iso("make_timestamp(CAST(round(right_value * 1000000) AS BIGINT))")} AS right_value, "count" FROM ({
            _histogram(
                ["s"],
                "(SELECT epoch(date_trunc('second', o_orderdate)) AS s FROM orders)",
                '''SELECT 's' AS "column", min(s)::DOUBLE AS lo, max(s)::DOUBLE AS hi, 10 AS bins
                   FROM (SELECT epoch(date_trunc('second', o_orderdate)) AS s FROM orders)''',
            )
        })""",
        "profile_counts": _per(
            [
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                "l_extendedprice",
                "l_shipdate",
                "l_discount",
                "l_tax",
                "l_returnflag",
            ],
            """'{c}' AS "column", count(*) AS total_count, count({c}) AS non_null_count, count({c}) AS valid_count""",
            LINEITEM_GAPS,
        ),
        "profile_numeric": _per(
            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"],
            """'{c}' AS "column", count({c}) AS finite_count, round(avg({c}::DOUBLE), 4) AS mean,
            round(stddev_pop({c}::DOUBLE), 4) AS standard_deviation, min({c})::DOUBLE AS minimum,
            max({c})::DOUBLE AS maximum""",
            LINEITEM_GAPS,
        ),
        "quantiles": "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", {p}::DOUBLE AS point,
            round(quantile_cont({c}::DOUBLE, {p}), 6) AS value FROM lineitem"""
            for c in ["l_orderkey", *MEASURES]
            for p in (0.25, 0.5, 0.75)
        ),
        "profile_string": "\nUNION ALL\n".join(_text_profile(c) for c in ("p_name", "p_brand", "p_type")),
        "top_values_long": _top_long("documents", ["text", "lang", "source"]),
        "top_values_once": _top_long("(SELECT html FROM pages UNION ALL SELECT html FROM pages WHERE page_id < 3)", ["html"]),
        "top_values": "\nUNION ALL\n".join(_top_values(c) for c in ("event_type", "props")),
        "profile_datetime": f"""SELECT 'o_orderdate' AS "column", {_iso(_mean_moment("o_orderdate"))} AS mean,
            {_iso("min(o_orderdate)")} AS minimum, {_iso("max(o_orderdate)")} AS maximum FROM orders""",
        "distinct_per_column": _per(
            [
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                "l_extendedprice",
                "l_shipdate",
                "l_discount",
                "l_tax",
                "l_returnflag",
            ],
            """'{c}' AS "column", count(DISTINCT {c}) AS unique_value_count""",
            LINEITEM_GAPS,
        ),
        "profile": _profile_table(),
        "profile_documents": _profile_documents(),
        "column_analysis": _column_analysis(),
        "type_mix": _type_mix(),
        "page_slice": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200",
        "free_dates": """SELECT o_orderkey, strftime(o_orderdate + CASE WHEN o_orderkey % 12 < 7 THEN INTERVAL 0 MINUTE
            WHEN o_orderkey % 12 = 10 THEN to_minutes(CAST(o_orderkey * 37 % 1440 // 60 * 60 AS INT))
            ELSE to_minutes(CAST(o_orderkey * 37 % 1440 AS INT)) END, '%Y-%m-%d %H:%M:%S') AS written FROM orders""",
        "free_date_columns": """SELECT 'written' AS "column", 'free' AS date_format""",
        "page_slice_deep": """SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber DESC, l_partkey, l_suppkey,
            l_extendedprice LIMIT 100 OFFSET 5400""",
        "page_after": """SELECT * FROM orders WHERE (o_custkey, o_orderkey) > (70, 500)
            ORDER BY o_custkey, o_orderkey LIMIT 40""",
        "page_from_index": """SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number FROM orders
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 250 OFFSET 1000""",
        "page_info": """SELECT count(*) AS "count", CAST(ceil(count(*) / 64.0) AS BIGINT) AS total_pages, 2 AS page,
            64 AS size, 2 < ceil(count(*) / 64.0) AS next, TRUE AS previous FROM orders""",
        "page_list": """SELECT unnest(range(1, CAST(ceil(count(*) / 64.0) AS BIGINT) + 1)) AS page FROM orders""",
        "head_rows": """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
            FROM customer ORDER BY c_custkey LIMIT 20""",
        "list_sorted": "SELECT * FROM supplier ORDER BY s_acctbal DESC",
        "latest_per_key": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
            FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
            FROM orders) WHERE r = 1""",
        "find_record": f"""SELECT _id, filename, project_id FROM {FILE_RECORDS} WHERE filename = 'f9.csv'
            AND NOT is_deleted""",
        "search_files": f"""SELECT _id, file, type FROM {FILE_RECORDS} WHERE file ILIKE '%urgent%' AND type = 'csv'
            AND NOT is_deleted AND NOT is_sample""",
        "search_text": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'",
        "active_records": f"SELECT _id, project_id FROM {FILE_RECORDS} WHERE NOT is_deleted",
        "files_of_project": f"SELECT _id, filename FROM {FILE_RECORDS} WHERE project_id = '70'",
        "files_of_projects": f"""SELECT _id, filename FROM {FILE_RECORDS} WHERE project_id IN
            (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "html_tables": """SELECT page_id, 0 AS table_index, 0 AS row_index, 'Page|Address' AS cells FROM pages
            UNION ALL SELECT page_id, 0, 1, page_id || '|<' || url || '>' FROM pages
            UNION ALL SELECT page_id, 1, 0, CAST(length(url) AS VARCHAR) FROM pages""",
        "widen_table_cells": """SELECT o_orderkey AS page_id, 0 AS table_index, 0 AS row_index, o_orderstatus AS c0,
            o_orderpriority AS c1 FROM orders
            UNION ALL SELECT o_orderkey, 0, 1, CAST(o_custkey AS VARCHAR), NULL FROM orders""",
        "cleansed_csv": f"""SELECT * FROM {CUSTOMER_GAPS} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""",
        "delimited_file": "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part",
        "json_lines": f"SELECT * FROM {CUSTOMER_GAPS}",
        "stored_profiles": _per(
            ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
            """'orders' AS file_id, 'tpch' AS project_id, '{c}' AS "column", count(*) AS total_count,
            count({c}) AS non_null_count, count({c}) AS valid_count""",
            "orders",
        ),
        "cleansed_profile": f"""WITH t AS (SELECT * FROM {CUSTOMER_GAPS} WHERE c_acctbal IS NOT NULL
              AND c_mktsegment IS NOT NULL)
            SELECT 'c_custkey' AS name, 'NUMERIC' AS type, count(*) AS total_count,
              round(quantile_cont(c_custkey::DOUBLE, 0.25), 4) AS q1, NULL::BIGINT AS unique_value_count FROM t
            UNION ALL SELECT 'c_acctbal', 'NUMERIC', count(*), round(quantile_cont(c_acctbal, 0.25), 4), NULL FROM t
            UNION ALL SELECT 'c_mktsegment', 'STRING', count(*), NULL, count(DISTINCT c_mktsegment) FROM t""",
        "stream_profile": "\nUNION ALL\n".join(_stream_profile(c) for c in ("value", "user_id")),
        "stream_value_counts": 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type',
    }
    for aggregation in (
        "sum",
        "average",
        "count",
        "minimum",
        "maximum",
        "std_deviation",
        "variance",
        "median",
        "count_distinct",
    ):
        sql[f"kpi_number_{aggregation}"] = _number_cards(aggregation, CUSTOMER_GAPS, ["c_acctbal", "c_custkey"])
    for aggregation in ("first", "last", "count", "count_distinct"):
        sql[f"kpi_category_{aggregation}"] = _category_cards(aggregation)
    for method in _RULES:
        sql[f"bin_count_{method}"] = (
            f"SELECT \"column\", n, lo, hi, bins FROM ({_layout(BIN_COLUMNS, 'lineitem', method)})"
        )
    return sql
