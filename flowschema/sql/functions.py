"""ClickHouse functions and types in Spark SQL."""

from __future__ import annotations

import re

from .lexer import SqlError


def _as(template: str):
    """{0}, {1}: arguments; {*}: all of them; {p}: the parameters."""

    def make(printer, call) -> str:
        args = [printer(a) for a in call.args]
        if call.distinct and args:
            args[0] = f"DISTINCT {args[0]}"
        params = ", ".join(printer(p) for p in call.params or [])
        out = template.replace("{*}", ", ".join(args)).replace("{p}", params)
        for i, a in enumerate(args):
            out = out.replace("{%d}" % i, a)
        if left := re.search(r"\{\d\}", out):
            raise SqlError(f"{call.name} lacks argument {left.group()}")
        return out

    return make


def _multi_if(printer, call) -> str:
    a = [printer(x) for x in call.args]
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(a[:-1:2], a[1::2])) + f" ELSE {a[-1]} END"


def _sort(printer, call) -> str:
    if len(call.args) == 1:
        return f"array_sort({printer(call.args[0])})"
    f, a = call.args
    x = f.params[0]
    return f"transform(array_sort(transform({printer(a)}, {x} -> struct({printer(f.body)} AS k, {x} AS v))), __s -> __s.v)"


def _map(printer, call) -> str:
    f, *arrays = call.args
    if len(arrays) == 1:
        return f"transform({printer(arrays[0])}, {printer(f)})"
    if len(arrays) == 2:
        return f"zip_with({printer(arrays[0])}, {printer(arrays[1])}, {printer(f)})"
    raise SqlError("arrayMap takes one or two arrays")


def _sum(printer, call) -> str:
    a = printer(call.args[-1])
    if len(call.args) == 2:
        a = f"transform({a}, {printer(call.args[0])})"
    # The sum begins with a zero of the elements' type; whole numbers add up as 64 bits.
    return f"aggregate({a}, coalesce(try_element_at(filter({a}, __x -> false), 1), 0L), (__a, __x) -> __a + __x)"


_MICROS = {"SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}


def _start_of_interval(printer, call) -> str:
    x, text = printer(call.args[0]), printer(call.args[1])
    m = re.fullmatch(r"INTERVAL '?(\d+)'? (SECOND|MINUTE|HOUR|DAY|WEEK)S?", text.strip("()"), re.I)
    if not m:
        raise SqlError(f"toStartOfInterval takes intervals of seconds to weeks, not {text}")
    step = int(m[1]) * _MICROS[m[2].upper()]
    shift = 3 * 86400 * 10**6 if m[2].upper() == "WEEK" else 0  # weeks begin on Monday; the epoch was a Thursday
    at = f"unix_micros(CAST({x} AS TIMESTAMP))"
    return f"timestamp_micros({at} - pmod({at} + {shift}, {step}))"


CLICKHOUSE = {
    "todate": _as("CAST({0} AS DATE)"), "todatetime": _as("CAST({0} AS TIMESTAMP)"), "toyear": _as("year({0})"), "tomonth": _as("month({0})"), "todayofmonth": _as("day({0})"),
    "todayofweek": _as("weekday({0}) + 1"), "tohour": _as("hour({0})"), "tominute": _as("minute({0})"), "tosecond": _as("second({0})"), "toquarter": _as("quarter({0})"),
    "toyyyymm": _as("(year({0}) * 100 + month({0}))"), "toyyyymmdd": _as("(year({0}) * 10000 + month({0}) * 100 + day({0}))"), "tostartofyear": _as("CAST(date_trunc('YEAR', {0}) AS DATE)"),
    "tostartofquarter": _as("CAST(date_trunc('QUARTER', {0}) AS DATE)"), "tostartofmonth": _as("CAST(date_trunc('MONTH', {0}) AS DATE)"), "tomonday": _as("CAST(date_trunc('WEEK', {0}) AS DATE)"),
    "tostartofinterval": _start_of_interval, "tostartofhour": _as("date_trunc('HOUR', {0})"), "tostartofminute": _as("date_trunc('MINUTE', {0})"), "tostartofday": _as("date_trunc('DAY', {0})"), "now": _as("current_timestamp()"), "today": _as("current_date()"),
    "datediff": lambda p, c: f"timestampdiff({p(c.args[0]).strip(chr(39)).upper()}, {p(c.args[1])}, {p(c.args[2])})", "adddays": _as("date_add({0}, {1})"), "tostring": _as("CAST({0} AS STRING)"),
    "toint8": _as("CAST({0} AS TINYINT)"), "toint16": _as("CAST({0} AS SMALLINT)"), "toint32": _as("CAST({0} AS INT)"), "toint64": _as("CAST({0} AS BIGINT)"), "touint8": _as("CAST({0} AS SMALLINT)"),
    "touint16": _as("CAST({0} AS INT)"), "touint32": _as("CAST({0} AS BIGINT)"), "touint64": _as("CAST({0} AS DECIMAL(20,0))"), "tofloat32": _as("CAST({0} AS FLOAT)"), "tofloat64": _as("CAST({0} AS DOUBLE)"),
    "todecimal64": _as("CAST({0} AS DECIMAL(18,{1}))"), "todecimal128": _as("CAST({0} AS DECIMAL(38,{1}))"), "toint32ornull": _as("TRY_CAST({0} AS INT)"), "toint64ornull": _as("TRY_CAST({0} AS BIGINT)"),
    "length": lambda p, c: f"size({p(c.args[0])})" if type(c.args[0]).__name__ == "Array" else f"octet_length({p(c.args[0])})", "lengthutf8": _as("char_length({0})"), "empty": _as("({0} = '')"), "notempty": _as("({0} <> '')"),
    "lowerutf8": _as("lower({0})"), "upperutf8": _as("upper({0})"), "splitbychar": _as("split({1}, concat('\\\\Q', {0}, '\\\\E'))"), "splitbystring": _as("split({1}, concat('\\\\Q', {0}, '\\\\E'))"),
    "position": _as("locate({1}, {0})"), "startswith": _as("startswith({0}, {1})"), "endswith": _as("endswith({0}, {1})"), "replaceall": _as("replace({0}, {1}, {2})"), "match": _as("({0} RLIKE {1})"), "trimboth": _as("trim({0})"),
    "multiif": _multi_if, "ifnull": _as("coalesce({0}, {1})"), "isnull": _as("({0} IS NULL)"), "isnotnull": _as("({0} IS NOT NULL)"), "intdiv": _as("({0} DIV {1})"), "modulo": _as("({0} % {1})"),
    "arraymap": _map, "arrayfilter": _as("filter({1}, {0})"), "arrayexists": _as("exists({1}, {0})"), "arrayall": _as("forall({1}, {0})"), "arraysort": _sort, "arraysum": _sum, "arrayjoin": _as("explode({0})"), "has": _as("array_contains({0}, {1})"),
    "arraydistinct": _as("array_distinct({0})"), "arrayconcat": _as("concat({*})"), "arrayreverse": _as("reverse({0})"), "arrayelement": _as("try_element_at({0}, {1})"), "arraymax": _as("array_max({0})"), "arraymin": _as("array_min({0})"),
    "range": _as("sequence(0, {0} - 1)"), "tuple": lambda p, c: "named_struct(" + ", ".join(f"'col{i}', {p(a)}" for i, a in enumerate(c.args, 1)) + ")", "grouparray": _as("collect_list({0})"), "groupuniqarray": _as("collect_set({0})"), "uniq": _as("approx_count_distinct({0})"), "uniqexact": _as("count(DISTINCT {*})"),
    "uniqcombined": _as("approx_count_distinct({0})"), "uniqhll12": _as("approx_count_distinct({0})"), "argmin": _as("min_by({0}, {1})"), "argmax": _as("max_by({0}, {1})"), "any": _as("first({0}, true)"), "anylast": _as("last({0}, true)"),
    "countif": _as("count_if({0})"), "sumif": _as("sum({0}) FILTER (WHERE {1})"), "avgif": _as("avg({0}) FILTER (WHERE {1})"), "minif": _as("min({0}) FILTER (WHERE {1})"), "maxif": _as("max({0}) FILTER (WHERE {1})"),
    "quantile": _as("percentile_approx({0}, {p})"), "quantileexact": _as("percentile({0}, {p})"), "quantiles": _as("percentile_approx({0}, array({p}))"), "median": _as("percentile({0}, 0.5)"), "topk": _as("approx_top_k({0}, {p})"),
    "stddevpop": _as("stddev_pop({0})"), "varpop": _as("var_pop({0})"), "stddevsamp": _as("stddev_samp({0})"), "varsamp": _as("var_samp({0})"), "rand": _as("CAST(rand() * 4294967296 AS BIGINT)"),
    "jsonextractstring": _as("get_json_object({0}, concat('$.', {1}))"), "jsonextractint": _as("CAST(get_json_object({0}, concat('$.', {1})) AS BIGINT)"), "jsonextractfloat": _as("CAST(get_json_object({0}, concat('$.', {1})) AS DOUBLE)"),
    "cityhash64": _as("xxhash64({*})"), "siphash64": _as("xxhash64({*})"), "xxhash64": _as("xxhash64({*})"),
}

_TYPES = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20,0)", "float32": "FLOAT", "float64": "DOUBLE",
    "string": "STRING", "date": "DATE", "date32": "DATE", "bool": "BOOLEAN", "uuid": "STRING",
}


def clickhouse_type(text: str) -> str:
    """A ClickHouse type as a Spark type; Spark's own names pass."""
    text = text.strip()
    name, _, rest = text.partition("(")
    low, inside = name.strip().lower(), rest.rstrip()[:-1] if rest else ""
    if low in _TYPES and not rest:
        return _TYPES[low]
    if low in ("nullable", "lowcardinality"):
        return clickhouse_type(inside)
    if low == "array":
        return f"ARRAY<{clickhouse_type(inside)}>"
    if low in ("datetime", "datetime64"):
        return "TIMESTAMP"
    if low == "fixedstring":
        return "STRING"
    if m := re.fullmatch(r"decimal(32|64|128)", low):
        return f"DECIMAL({ {'32': 9, '64': 18, '128': 38}[m.group(1)] },{inside})"
    return text
