"""Statement trees to Spark: dialect constructs that Spark lacks become compositions of what Catalyst has.

The result is Spark SQL text, so that the optimizer sees one declarative plan. Meanings of the ClickHouse-only constructs:

* LIMIT n BY k: the first n rows of each k, in the order of ORDER BY (of all columns if there is none).
* LIMIT n WITH TIES, TOP n WITH TIES: also the rows that equal the n-th in ORDER BY.
* WITH TOTALS: one more row with null keys over all rows (before HAVING), also beside ROLLUP and CUBE.
* MATERIALIZED VIEW v TO t AS q: t is filled with the rows of q. SETTINGS and a FORMAT without a file have no meaning here: a warning says so.
* ARRAY JOIN a, b: one row per element, arrays in lockstep; LEFT keeps rows of empty arrays.
* ANY JOIN: at most one match per row (the least right row of a key). SEMI and ANTI in either word order.
* ASOF JOIN: equal keys, and of the rows that meet the inequality the nearest.
* SAMPLE r OFFSET o: rows whose hash lies in [o, o + r) of the unit interval. FINAL: the last version of each key (of equal versions the
  greatest row).
* uniqExact and quantileExact over all rows of a table: subqueries of their own. Beside other aggregates, a distinct count makes Spark keep the states of all of them
  for each distinct value, and an exact percentile gathers all distinct values in one task.
* GROUP BY columns of a table and of its exploded arrays: rows of a large table are brought together before they are exploded, if those columns spread them well.
* PREWHERE: a conjunct of WHERE. GLOBAL and LOCAL: distribution hints, without a meaning of their own here.
* Nulls are last in ORDER BY unless it says otherwise. Arrays count from 1.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ast as A
from .functions import CLICKHOUSE, clickhouse_type
from .lexer import SqlError
from .parser import parse, parse_one
from .printer import Printer

_HASH_SPACE = 1 << 20
#: Bytes of a table in each part that is exploded and grouped by one task, so that its groups fit in memory.
PART_BYTES = 16 << 20
#: What depends on where a row lies or is new at each call.
_UNSTEADY = ("rand", "randn", "random", "uuid", "shuffle", "monotonically_increasing_id", "spark_partition_id", "input_file_name", "input_file_block_start", "input_file_block_length")


@dataclass
class Keys:
    """What FINAL and SAMPLE need to know of a table: key and version columns, and the expression to sample by."""

    order_by: list[str] = field(default_factory=list)
    version: str | None = None
    sample_by: str | None = None


class SparkPrinter(Printer):
    def __init__(self, dialect: str = "spark", variables: dict[str, str] | None = None, keys: dict[str, Keys] | None = None, relation=None, spread=None):
        self.clickhouse = dialect == "clickhouse"
        self.variables, self.keys = variables or {}, keys or {}
        self.named_values: dict[str, str] = {}
        self.relation = relation  # makes a view of an ASOF join and returns its name
        self.spread = spread  # into how many parts to put the rows of a table by some columns, or None
        self.parts: tuple[A.Table, str] | None = None  # the table to put in parts, its hint
        self.count = 0
        self.free = self.outer_free = True  # the next query, the one around: it can't refer to columns of queries around it
        self.ctes: set[str] = set()
        self.rows = ""  # FROM and WHERE of the select whose exact aggregates become subqueries

    def fresh(self, word: str) -> str:
        self.count += 1
        return f"__{word}{self.count}"

    # Expressions

    def identifier(self, x: str) -> str:
        def value(m: re.Match) -> str:
            if m.group(1) not in self.variables:
                raise SqlError(f"no value for ${{{m.group(1)}}}")
            return self.variables[m.group(1)]

        x = re.sub(r"\$\{(\w+)\}", value, x)
        return f"`{x[1:-1]}`" if x[:1] == '"' else x

    def p_Name(self, n):
        whole = ".".join(n.parts)
        if whole in self.named_values:
            return self.named_values[whole]
        return ".".join(self.identifier(p) for p in n.parts)

    def p_Call(self, n):
        if self.clickhouse and n.name.lower() == "count" and not n.args:
            n = replace(n, args=[A.Star()])
        if self.rows and _exact(n):
            return self.apart(n)
        if self.clickhouse and n.over is None:
            if made := CLICKHOUSE.get(n.name.lower()):
                return made(self, n)
            if n.params is not None:
                raise SqlError(f"no meaning for {n.name} with parameters")
        return super().p_Call(n)

    def apart(self, n: A.Call) -> str:
        """An exact aggregate over all rows, which reads them in a subquery of its own. max() leaves it an aggregate."""
        rows, self.rows = self.rows, ""
        args = [self(a) for a in n.args]
        if n.name.lower() in ("uniqexact", "count"):
            names = ", ".join(f"{a} AS __x{i}" for i, a in enumerate(args))
            out = f"coalesce(max((SELECT count(*) FROM (SELECT DISTINCT {names} {rows}) WHERE {' AND '.join(f'__x{i} IS NOT NULL' for i in range(len(args)))})), 0L)"
        else:
            out = f"max(({_quantile(args[0], float(n.params[0].text) if n.params else 0.5, rows)}))"
        self.rows = rows
        return out

    def splits(self, n: A.Select) -> bool:
        """Whether the exact aggregates of n can be read apart: the rows are those of tables, the same each time, and the arguments are columns of theirs."""
        if not (self.clickhouse and self.outer_free and n.source is not None and n.group is None and not n.distinct and not n.windows):
            return False
        output = [*n.items, *([n.having] if n.having is not None else [])]
        exact = [x for o in output for x in o.walk() if _exact(x)]
        if any(_exact(x) for o in n.items if not isinstance(o, A.Aliased) for x in o.walk()):
            return False  # the text of the call names the column
        inside = {id(y) for x in exact for y in x.walk()}
        if {x.name.lower() for x in exact} <= {"uniqexact", "count"} and len({repr(x) for x in exact}) < 2 and not any(isinstance(x, A.Call) and id(x) not in inside for o in output for x in o.walk()):
            return False  # nothing, or a distinct count alone
        source = list(n.source.walk())
        if any(not isinstance(x, (A.Table, A.Join)) or getattr(x, "tablesample", None) or isinstance(x, A.Table) and x.name[-1] in self.ctes or isinstance(x, A.Join) and "ASOF" in x.words for x in _relations(n.source)) or any(isinstance(x, A.Query) for x in source):
            return False
        aliases = {o.alias for o in n.items if isinstance(o, A.Aliased)}
        if any(isinstance(x, A.Query) or isinstance(x, A.Name) and x.parts[0] in aliases and len(x.parts) == 1 for e in exact for x in e.walk()):
            return False
        read = [*source, *([x for x in n.where.walk()] if n.where is not None else []), *(x for e in exact for x in e.walk())]
        return not any(isinstance(x, A.Call) and x.name.lower() in _UNSTEADY for x in read)

    def parted(self, n: A.Select) -> tuple[A.Table, str] | None:
        """The table of n to put in parts by those of its columns that n groups by, next to columns of its exploded arrays."""
        table, made = n.source, set()
        while isinstance(table, (A.LateralView, A.ArrayJoin)):
            made |= set(table.columns) if isinstance(table, A.LateralView) else {i.alias if isinstance(i, A.Aliased) else getattr(i, "parts", [""])[-1] for i in table.items}
            table = table.relation
        g = n.group
        if self.spread is None or not self.outer_free or table is n.source or g is None or g.function or g.modifiers or g.sets is not None or not isinstance(table, A.Table):
            return None
        if len(table.name) > 1 or table.final or table.sample or table.tablesample or table.columns or table.name[0] in self.ctes:
            return None
        if any(isinstance(x, A.Call) and x.name.lower() in _UNSTEADY or isinstance(x, A.Name) and "_metadata" in x.parts for x in n.walk()):
            return None
        aliases = {o.alias for o in n.items if isinstance(o, A.Aliased)}
        owner = table.alias or table.name[0]
        keys = [x.parts[-1] for x in g.items if isinstance(x, A.Name) and (len(x.parts) == 1 and not {x.parts[0]} & (made | aliases) or len(x.parts) == 2 and x.parts[0] == owner)]
        if not keys or len(keys) == len(g.items):
            return None
        keys = [self.identifier(k) for k in keys]
        count = self.spread(self.identifier(table.name[0]), keys)
        return (table, f"/*+ REPARTITION({count}, {', '.join(keys)}) */") if count else None

    def p_FromQuery(self, n):
        self.free = self.outer_free
        return super().p_FromQuery(n)

    def p_Cte(self, n):
        self.free = self.outer_free
        return super().p_Cte(n)

    def p_Lambda(self, n):
        return (n.params[0] if len(n.params) == 1 else f"({', '.join(n.params)})") + f" -> {self(n.body)}"

    def p_Binary(self, n):
        return f"{self(n.left)} {'=' if n.op == '==' else n.op} {self(n.right)}"

    def p_In(self, n):
        if isinstance(n.items, A.Name):
            if self.clickhouse:
                return f"{self(n.x)} {'NOT ' if n.negated else ''}IN (SELECT * FROM {self(n.items)})"
            return ("NOT " if n.negated else "") + f"array_contains({self(n.items)}, {self(n.x)})"
        return super().p_In(n)

    def in_words(self, n):
        return "NOT IN" if n.negated else "IN"

    def p_Ternary(self, n):
        return f"if({self(n.test)}, {self(n.yes)}, {self(n.no)})"

    def p_Case(self, n):
        return super().p_Case(replace(n, ended=True))

    def p_Array(self, n):
        return f"array({self.many(n.items)})"

    def p_Index(self, n):
        return f"try_element_at({self(n.x)}, {self(n.at)})" if self.clickhouse else super().p_Index(n)

    def p_Lit(self, n):
        text = super().p_Lit(n)
        return text + "D" if self.clickhouse and re.fullmatch(r"\d*\.\d+", text) else text  # ClickHouse reads 0.5 as a float

    def p_Field(self, n):
        if n.name.isdigit() and isinstance(n.x, A.Tuple) and 0 < int(n.name) <= len(n.x.items):
            return self(n.x.items[int(n.name) - 1])
        return f"{self(n.x)}.col{n.name}" if n.name.isdigit() else super().p_Field(n)

    def p_Cast(self, n):
        kind = clickhouse_type(n.type) if self.clickhouse else n.type
        return f"{'TRY_CAST' if n.word == 'TRY_CAST' else 'CAST'}({self(n.x)} AS {kind})"

    def p_Exists(self, n):
        return f"EXISTS ({self(n.query)})"

    def p_FloorTo(self, n):
        return f"date_trunc('{n.unit}', {self(n.x)})"

    def p_Typed(self, n):
        return f"{'TIMESTAMP_LTZ' if n.word == 'TIMESTAMPLOCALTZ' else n.word} {n.text}"

    def p_OrderItem(self, n):
        nulls = n.nulls or ("LAST" if self.clickhouse else "")
        x = self(n.x) + (f" COLLATE {n.collate.strip(chr(39))}" if n.collate else "")
        return x + (f" {n.direction}" if n.direction else "") + (f" NULLS {nulls}" if nulls else "")

    def p_Window(self, n):
        return super().p_Window(replace(n, words=("PARTITION BY", "ORDER BY"), order=n.order if n.words[0] != "CLUSTER BY" else [A.OrderItem(x) for x in n.partition]))

    # Relations

    def p_Table(self, n):
        text = ".".join(self.identifier(x) for x in n.name)
        short = n.name[-1]
        if n.final:
            k = self.keys.get(short)
            if not k or not k.order_by:
                raise SqlError(f"FINAL needs the key columns of {short}")
            # An aggregate, so that each task keeps one row of a key before anything is shuffled. A null version is the least.
            best = f"max(struct({k.version} AS v, struct(*) AS r))" if k.version else "max(struct(struct(*) AS r))"
            text = f"(SELECT __best.r.* FROM (SELECT {best} AS __best FROM {text} GROUP BY {', '.join(k.order_by)}))"
        if n.sample:
            k = self.keys.get(short)
            by = (k.sample_by if k else None) or "*"
            begin = self(n.sample[1]) if n.sample[1] is not None else "0"
            unit = f"pmod(xxhash64({by}), {_HASH_SPACE}) / {_HASH_SPACE}D"
            text = f"(SELECT * FROM {text} WHERE {unit} >= {begin} AND {unit} < {begin} + {self(n.sample[0])})"
        if n.tablesample:
            kind, *rest = n.tablesample
            if kind == "BUCKET" and rest[2] is not None:
                text = f"(SELECT * FROM {text} WHERE pmod(hash({self(rest[2])}), {rest[1]}) = {rest[0]} - 1)"
            elif kind == "BUCKET":
                text += f" TABLESAMPLE (BUCKET {rest[0]} OUT OF {rest[1]})"
            else:
                text += f" TABLESAMPLE ({rest[0]} {kind})"
        if self.parts is not None and self.parts[0] is n:
            text = f"(SELECT {self.parts[1]} * FROM {text})"
        alias = n.alias or (short if text.startswith("(") else None)
        return self.named(replace(n, alias=alias), text)

    def options(self, n, text):
        return text

    def p_FromCall(self, n):
        name, args = n.call.name.lower(), n.call.args
        if self.clickhouse and name in ("numbers", "file", "s3", "url", "hdfs"):
            if name == "numbers":
                text = f"(SELECT id AS number FROM range({self.many(args)}))"
            else:
                kind = self(args[1]).strip("'").lower() if len(args) > 1 else "parquet"
                text = {"jsoneachrow": "json", "csvwithnames": "csv"}.get(kind, kind) + f".`{self(args[0]).strip(chr(39))}`"
            return self.named(n, text)
        return super().p_FromCall(n)

    def p_Values(self, n):
        return self.named(n, f"(VALUES {self.many(n.rows)})")

    def p_LateralView(self, n):
        return super().p_LateralView(replace(n, comma=False))

    def p_LateralTable(self, n):
        return f"{self(n.relation)} CROSS JOIN (VALUES {self.many(n.rows)}) AS {n.alias or self.fresh('t')}" + (f" ({', '.join(n.columns)})" if n.columns else "")

    def p_ArrayJoin(self, n):
        view, arrays, names = self.fresh("array"), [], []
        for item in n.items:
            x, alias = (item.x, item.alias) if isinstance(item, A.Aliased) else (item, None)
            arrays.append(self(x))
            names.append(alias or (x.parts[-1] if isinstance(x, A.Name) else self.fresh("item")))
            if not alias:
                self.named_values[arrays[-1]] = f"{view}.{names[-1]}"
        outer = "OUTER " if "LEFT" in n.words else ""
        if len(arrays) == 1:
            return f"{self(n.relation)} LATERAL VIEW {outer}explode({arrays[0]}) {view} AS {names[0]}"
        return f"{self(n.relation)} LATERAL VIEW {outer}inline(arrays_zip({', '.join(arrays)})) {view} AS {', '.join(names)}"

    def right_keys(self, n: A.Join) -> list[str]:
        if n.using is not None:
            return n.using
        right = _name_of(n.right)
        found = []
        for x in _conjuncts(n.on):
            if isinstance(x, A.Binary) and x.op in ("=", "=="):
                found += [s.parts[-1] for s in (x.left, x.right) if isinstance(s, A.Name) and len(s.parts) > 1 and s.parts[0] == right]
        if not found:
            raise SqlError("ANY JOIN needs USING or equalities with columns of the right side")
        return found

    def p_Join(self, n):
        words = set(n.words.split())
        if n.words == "," or not words & {"GLOBAL", "LOCAL", "ANY", "ALL", "ASOF", "SEMI", "ANTI"}:
            return super().p_Join(n)
        if "ASOF" in words:
            return self.asof(n)
        side = next((w for w in ("LEFT", "RIGHT", "FULL", "CROSS") if w in words), "INNER")
        kind = next((w for w in ("SEMI", "ANTI") if w in words), "")
        if kind and side == "RIGHT":
            n = replace(n, left=n.right, right=n.left)
        if kind:
            side = "LEFT"
        right = n.right
        if "ANY" in words and not kind:
            if side == "RIGHT":
                n, side = replace(n, left=n.right, right=n.left), "LEFT"
                right = n.right
            keys, alias = ", ".join(self.right_keys(replace(n, right=right))), _name_of(right)
            text = f"(SELECT __row.* FROM (SELECT min(struct(*)) AS __row FROM {self(right)} GROUP BY {keys})) AS {alias or self.fresh('any')}"
        else:
            text = self(right)
        out = f"{self(n.left)} {side} {kind + ' ' if kind else ''}JOIN {text}"
        if n.on is not None:
            out += f" ON {self(n.on)}"
        if n.using is not None:
            out += f" USING ({', '.join(n.using)})"
        return out

    def asof(self, n: A.Join) -> str:
        if self.relation is None:
            raise SqlError("ASOF JOIN is run, not printed")
        left, right = _name_of(n.left), _name_of(n.right)
        if not left or not right:
            raise SqlError("ASOF JOIN needs names for both sides")
        if n.using is not None:
            pairs, near = [(c, c) for c in n.using[:-1]], (n.using[-1], ">=", n.using[-1])
        else:
            pairs, near = [], None
            for x in _conjuncts(n.on):
                a, b, op = x.left, x.right, x.op
                if not (isinstance(a, A.Name) and isinstance(b, A.Name)):
                    raise SqlError("ASOF JOIN compares columns")
                if a.parts[0] == right:
                    a, b, op = b, a, {">=": "<=", "<=": ">=", ">": "<", "<": ">"}.get(op, op)
                if op in ("=", "=="):
                    pairs.append((a.parts[-1], b.parts[-1]))
                else:
                    near = (a.parts[-1], op, b.parts[-1])
            if near is None:
                raise SqlError("ASOF JOIN needs one inequality")
        return self.relation(self(n.left), left, self(n.right), right, pairs, near, "LEFT" in n.words)

    # Queries

    def p_Group(self, n):
        if len(n.items) == 1 and isinstance(n.items[0], A.Tuple) and not n.items[0].items and n.sets is None:
            return ""  # GROUP BY (): one group of all rows
        items = self.many(n.items)
        if n.sets is not None:  # with the sets named, ROLLUP adds nothing
            sets = [f"({self.many(s)})" for s in n.sets]
            return f"GROUP BY GROUPING SETS ({', '.join(sets)})"
        if not n.items:
            return ""
        kind = n.function or next((m for m in n.modifiers if m != "TOTALS"), "")
        if "TOTALS" in n.modifiers and not kind:
            return f"GROUP BY GROUPING SETS (({items}), ())"
        if "TOTALS" in n.modifiers:
            # The totals are a row of their own, beside the one that ROLLUP and CUBE have for all rows.
            one = [self(x) for x in n.items]
            sets = [one[:k] for k in range(len(one), -1, -1)] if kind.upper() == "ROLLUP" else [[x for i, x in enumerate(one) if bits >> i & 1] for bits in range(1 << len(one))]
            return f"GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in [*sets, []])})"
        return f"GROUP BY {kind} ({items})" if kind else f"GROUP BY {items}"

    def p_Select(self, n):
        if n.prewhere is not None:
            both = n.prewhere if n.where is None else A.Binary("AND", A.Tuple([n.prewhere]), A.Tuple([n.where]))
            n = replace(n, prewhere=None, where=both)
        if n.group is not None and "TOTALS" in n.group.modifiers and n.having is not None:
            n = replace(n, having=A.Binary("OR", A.Tuple([n.having]), A.Binary("=", A.Call("grouping_id", []), A.Lit(str((1 << len(n.group.items)) - 1)))))
        splits = self.splits(n)
        outside, self.rows = self.rows, ""
        self.parts = self.parted(n)
        source = self(n.source) if n.source is not None else None  # first: it may name values
        where = self(n.where) if n.where is not None else None
        if splits:
            self.rows = f"FROM {source}" + (f" WHERE {where}" if where else "")
        text = super().p_Select(replace(n, source=None, top=None, where=None, group=None, having=None, windows=[]))
        if n.hint:
            text = text.replace("SELECT", f"SELECT /*+ {n.hint} */", 1)
        parts = [text]
        if source:
            parts.append(f"FROM {source}")
        if where is not None:
            parts.append(f"WHERE {where}")
        if n.group is not None:
            parts.append(self(n.group))
        if n.having is not None:
            parts.append(f"HAVING {self(n.having)}")
        self.rows = outside
        if n.windows:
            parts.append("WINDOW " + ", ".join(f"{name} AS {self(w)}" for name, w in n.windows))
        return " ".join(p for p in parts if p)

    def with_(self, n):
        self.ctes |= {c.name for c in n.ctes if c.scalar is None}
        for c in n.ctes:
            if c.scalar is not None:
                self.named_values[c.name] = f"({self(c.scalar)})"
        queries = [c for c in n.ctes if c.scalar is None]
        return [f"WITH {self.many(queries)}"] if queries else []

    def p_Query(self, n):
        before, around, ctes, rows = dict(self.named_values), self.outer_free, set(self.ctes), self.rows
        self.outer_free, self.free, self.rows = self.free, False, ""
        try:
            text = self._query(n)
        finally:
            self.named_values, self.outer_free, self.free, self.ctes, self.rows = before, around, False, ctes, rows
        return f"({text})" if n.in_parens else text

    def _query(self, n):
        top = n.body.top if isinstance(n.body, A.Select) else None
        limit = A.Limit(A.Lit(top[0]), ties=top[1]) if top and n.limit is None else n.limit
        head = self.with_(n)
        select, order, hidden, keys = n.body, n.order, [], n.limit_by.by if n.limit_by is not None else []
        if (keys or limit is not None and limit.ties) and isinstance(select, A.Select) and not select.distinct and not n.sets:
            # The ranking may use columns that the query doesn't return: they go along under names of their own.
            hidden = [A.Aliased(x, f"__o{i}") for i, x in enumerate([o.x for o in order] + keys)]
            select = replace(select, items=[*select.items, *hidden])
            order = [replace(o, x=A.Name([h.alias])) for o, h in zip(order, hidden)]
            keys = [A.Name([h.alias]) for h in hidden[len(order) :]]
        body = self(select)
        for op, q in n.sets:
            body += f" {'EXCEPT' + op[5:] if op.startswith('MINUS') else op} {self(q)}"
        order = f"ORDER BY {self.many(order)}" if order else ""
        gone = [h.alias for h in hidden]
        if n.limit_by is not None:
            first = self(n.limit_by.offset) if n.limit_by.offset is not None else "0"
            ranked = f"SELECT *, row_number() OVER (PARTITION BY {self.many(keys)} {order or 'ORDER BY struct(*)'}) AS __n FROM ({body})"
            ends_here = not (limit is not None and limit.ties)
            body = f"SELECT * EXCEPT ({', '.join(['__n', *(gone if ends_here else [])])}) FROM ({ranked}) WHERE __n > {first} AND __n <= {first} + {self(n.limit_by.count)}"
        if limit is not None and limit.ties:
            if not order:
                raise SqlError("WITH TIES needs ORDER BY")
            skip = self(limit.offset) if limit.offset is not None else "0"
            if hidden and n.order:
                # Rows as good as the first skip + count are those that share their sort keys: a top-k and a semi join leave few to rank.
                by = [h.alias for h in hidden[: len(n.order)]]
                first = f"SELECT DISTINCT {', '.join(f'{c} AS {c}t' for c in by)} FROM (SELECT {', '.join(by)} FROM ({body}) {order} LIMIT {skip} + {self(limit.count)})"
                body = f"SELECT __all.* FROM ({body}) AS __all LEFT SEMI JOIN ({first}) AS __top ON {' AND '.join(f'{c} <=> {c}t' for c in by)}"
            ranked = f"SELECT *, rank() OVER ({order}) AS __r, row_number() OVER ({order}) AS __n FROM ({body})"
            body, limit = f"SELECT * EXCEPT ({', '.join(['__r', '__n', *gone])}) FROM ({ranked}) WHERE __n > {skip} AND __r <= {skip} + {self(limit.count)}", None
        parts = [*head, body, order]
        if not order:
            for word, items in (("CLUSTER BY", n.cluster), ("DISTRIBUTE BY", n.distribute), ("SORT BY", n.sort)):
                if items:
                    parts.append(f"{word} {self.many(items)}")
        if limit is not None:
            parts.append(f"LIMIT {self(limit.count)}" + (f" OFFSET {self(limit.offset)}" if limit.offset is not None else ""))
        return " ".join(p for p in parts if p)

    def p_Limit(self, n):
        return super().p_Limit(replace(n, comma=False))

    # Statements

    def p_Create(self, n):
        kind = n.kind
        if n.to and n.query is not None:
            return f"INSERT INTO {'.'.join(n.to)} {self(n.query)}"
        if not self.clickhouse and n.clauses:
            n = _stored(n)
        if n.query is not None and kind in ("MATERIALIZED VIEW", "LIVE VIEW"):
            kind = "TABLE" if kind == "MATERIALIZED VIEW" else "TEMPORARY VIEW"
        if self.clickhouse:
            n = replace(n, clauses="", columns="" if n.query is not None else n.columns)
        if kind == "TEMPORARY VIEW" and n.query is None:
            n = replace(n, replace=n.replace)
        return super().p_Create(replace(n, kind=kind))

    def p_Drop(self, n):
        return super().p_Drop(replace(n, kind="TABLE" if n.kind == "MATERIALIZED VIEW" else n.kind))


_STORED = {"textfile": "csv", "jsonfile": "json", "sequencefile": "parquet", "rcfile": "orc"}


def _stored(n: A.Create) -> A.Create:
    """STORED AS, ROW FORMAT and SKEWED BY of Hive as a Spark data source; the other clauses stay."""
    clauses, options, form = n.clauses, dict(n.options), n.format
    clauses = re.sub(r"\bSKEWED BY \([^)]*\) ON \((?:[^()]|\([^)]*\))*\)( STORED AS DIRECTORIES)?", "", clauses, flags=re.I)
    if m := re.search(r"\bSTORED AS (INPUTFORMAT '([^']*)' OUTPUTFORMAT '[^']*'|\w+)", clauses, re.I):
        word = (m[2] or m[1]).lower()
        form = form or next((f for f in ("parquet", "orc", "avro", "json") if f in word), _STORED.get(word, word))
        clauses = clauses.replace(m[0], "")
    if m := re.search(r"\bROW FORMAT DELIMITED((?: (?:FIELDS|LINES|COLLECTION ITEMS|MAP KEYS) TERMINATED BY '[^']*'| ESCAPED BY '[^']*'| NULL DEFINED AS '[^']*')*)", clauses, re.I):
        for pattern, name in ((r"FIELDS TERMINATED BY ('[^']*')", "sep"), (r"LINES TERMINATED BY ('[^']*')", "lineSep"), (r"NULL DEFINED AS ('[^']*')", "nullValue")):
            if x := re.search(pattern, m[1], re.I):
                options[name] = x[1]
        form, clauses = form or "csv", clauses.replace(m[0], "")
    return replace(n, clauses=" ".join(clauses.split()), options=options, format=form)


def _exact(x) -> bool:
    """An aggregate that Spark evaluates with all distinct values at hand, in the forms that can be read apart."""
    if not isinstance(x, A.Call) or x.over is not None or x.where is not None or not x.args or any(isinstance(a, (A.Star, A.Lambda)) for a in x.args):
        return False
    name = x.name.lower()
    if name in ("uniqexact", "count"):
        return x.distinct or name == "uniqexact"
    level = x.params or []
    return not x.distinct and len(x.args) == 1 and (name == "median" and not level or name == "quantileexact" and len(level) == 1 and isinstance(level[0], A.Lit) and bool(re.fullmatch(r"0?\.\d+|[01](\.0*)?", level[0].text)))


def _relations(x) -> list:
    """The tables and joins of FROM; anything else as it is."""
    return [x, *_relations(x.left), *_relations(x.right)] if isinstance(x, A.Join) else [x]


def _quantile(x: str, level: float, rows: str) -> str:
    """percentile(x, level) over rows, exactly, as a query. Approximate cuts around the place divide the rows in three; of the parts that hold it alone the values are put in order.
    Poor cuts make the parts larger, not the result wrong."""
    values = f"(SELECT CAST({x} AS DOUBLE) AS __x {rows})"
    cuts = f"(SELECT percentile_approx(__x, array({max(level - 0.0005, 0):.10f}D, {min(level + 0.0005, 1):.10f}D), 10000) AS __c FROM {values})"
    parts = f"(SELECT any_value(__c[0]) AS __lo, any_value(__c[1]) AS __hi, count_if(__x < __c[0]) AS __below, count_if(__x <= __c[1]) AS __until, (count(__x) - 1) * {level!r}D AS __at FROM {values} CROSS JOIN {cuts})"
    place = f"(SELECT *, CASE WHEN floor(__at) < __below THEN 0L WHEN floor(__at) < __until THEN __below ELSE __until END AS __start FROM {parts})"
    held = "floor(__at) < __below AND __x < __lo OR floor(__at) < __until AND ceil(__at) >= __below AND __x >= __lo AND __x <= __hi OR ceil(__at) >= __until AND __x > __hi"
    counts = f"(SELECT __x, count(*) AS __n, any_value(__start) AS __start, any_value(__at) AS __at FROM {values} CROSS JOIN {place} WHERE {held} GROUP BY __x)"
    ends = f"(SELECT __x, __at, __start + sum(__n) OVER (ORDER BY __x ROWS UNBOUNDED PRECEDING) AS __end FROM {counts})"
    two = f"(SELECT min(__x) FILTER (WHERE __end > floor(__at)) AS __a, min(__x) FILTER (WHERE __end > ceil(__at)) AS __b, any_value(__at) AS __at FROM {ends})"
    return f"SELECT if(__a = __b, __a, (ceil(__at) - __at) * __a + (__at - floor(__at)) * __b) FROM {two}"


def _name_of(relation) -> str | None:
    return getattr(relation, "alias", None) or (relation.name[-1] if isinstance(relation, A.Table) else None)


def _conjuncts(x) -> list:
    if isinstance(x, A.Tuple) and len(x.items) == 1:
        return _conjuncts(x.items[0])
    if isinstance(x, A.Binary) and x.op == "AND":
        return _conjuncts(x.left) + _conjuncts(x.right)
    return [x]


def to_spark_sql(text: str, dialect: str = "spark", variables: dict[str, str] | None = None, keys: dict[str, Keys] | None = None) -> str:
    """One statement as Spark SQL."""
    return SparkPrinter(dialect, variables, keys)(parse_one(text, dialect))


def run(spark: SparkSession, text: str, dialect: str = "spark", variables: dict[str, str] | None = None, keys: dict[str, Keys] | None = None) -> DataFrame | None:
    """Run the statements of a text; the DataFrame of the last one. INTO OUTFILE writes and returns what it wrote."""
    from ..operators.joins import asof_join

    views = 0

    def relation(left: str, left_name: str, right: str, right_name: str, pairs: list, near: tuple, outer: bool) -> str:
        nonlocal views
        views += 1
        view = f"__asof_{views}_{abs(hash((left, right))) % 10**8}"
        joined = asof_join(spark.sql(f"SELECT * FROM {left}"), spark.sql(f"SELECT * FROM {right}"), pairs, near, outer, names=(left_name, right_name))
        joined.createOrReplaceTempView(view)
        return view

    def spread(table: str, keys: list[str]) -> int | None:
        """None if the table is small, or if rows of one key would make a part of their own."""
        try:
            rows = spark.table(table)
        except AnalysisException:
            return None  # the query itself says what is wrong
        parts = -(-int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)
        if parts < 2 or not {k.strip("`").lower() for k in keys} <= {c.lower() for c in rows.columns}:
            return None
        total, most = rows.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
        return parts if total and most * 4 * parts <= total else None

    out = None
    for statement in parse(text, dialect):
        if isinstance(statement, A.Query):
            unused = [w for w, there in (("SETTINGS", getattr(statement, "settings", None)), ("FORMAT", statement.format and not statement.outfile)) if there]
            if unused:
                warnings.warn(f"{' and '.join(unused)} without effect here", stacklevel=2)
        sql = SparkPrinter(dialect, variables, keys, relation, spread if isinstance(statement, A.Query) else None)(statement)
        out = spark.sql(sql)
        if isinstance(statement, A.Query) and statement.outfile:
            kind = {"": "csv", "csvwithnames": "csv", "jsoneachrow": "json", "tabseparated": "csv"}.get(statement.format.lower(), statement.format.lower())
            out.write.format(kind).save(statement.outfile.strip("'"))
    return out
