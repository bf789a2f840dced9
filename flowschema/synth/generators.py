"""Generator specs to Spark columns.

A spec is a constant, None, or a tuple (name, arguments...). A generator is a function of a Row: the column of the global row
index, the path of the field and the seed. Random draws are hashes of (index, path, seed), so a value can be computed
anywhere, again, and at another index: that is what `field` (an earlier record) and `joint` (another table's key) use.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import providers

_SPACE = 1 << 52


@dataclass(frozen=True)
class Row:
    """Where a value is made: index (a long column), path, seed; resolve finds the generators of sibling fields."""

    index: Column
    path: str = ""
    seed: int = 42
    salt: tuple[Column, ...] = ()
    siblings: dict[str, Any] | None = None

    def at(self, name: str, **changes) -> Row:
        return replace(self, path=f"{self.path}/{name}", **changes)

    def hashed(self, *more: Column | int | str) -> Column:
        parts = [x if isinstance(x, Column) else F.lit(x) for x in more]
        return F.xxhash64(self.index, F.lit(self.path), F.lit(self.seed), *self.salt, *parts)

    def uniform(self, *more) -> Column:
        """U[0, 1) with 52 bits."""
        return F.pmod(self.hashed(*more), F.lit(_SPACE)) / F.lit(float(_SPACE))


Generator = Callable[[Row], Column]
_REGISTRY: dict[str, Callable[..., Generator]] = {}


def register_generator(name: str):
    """Add a spec name: the function takes the arguments of the spec and returns a generator."""

    def add(f: Callable[..., Generator]) -> Callable[..., Generator]:
        _REGISTRY[name] = f
        return f

    return add


def build(spec: Any) -> Generator:
    """The generator of a spec."""
    if isinstance(spec, tuple) and spec and isinstance(spec[0], str) and spec[0] in _REGISTRY:
        return _REGISTRY[spec[0]](*spec[1:])
    if callable(spec):
        return spec
    if isinstance(spec, (tuple, list)) and spec and isinstance(spec[0], str):
        raise ValueError(f"unknown generator {spec[0]}")
    return lambda row: F.lit(spec)


@register_generator("val")
def _val(x: Any = None) -> Generator:
    return lambda row: F.lit(x)


@register_generator("inc")
def _inc(start: int = 0, step: int = 1, limit: int | None = None) -> Generator:
    """start + (i * step) mod limit, with a remainder of the sign of limit."""

    def make(row: Row) -> Column:
        moved = row.index * step
        if limit:
            moved = F.pmod(moved, F.lit(limit)) if limit > 0 else -F.pmod(-moved, F.lit(-limit))
        return (F.lit(start) + moved).cast("long")

    return make


@register_generator("seq")
def _seq(start: Any, length: Any) -> Generator:
    """start, start + 1, ...; null where the length is null."""
    s, n = build(start), build(length)

    def make(row: Row) -> Column:
        first, count = s(row.at("start")).cast("long"), n(row.at("len")).cast("long")
        return F.when(count > 0, F.sequence(first, first + count - 1)).when(count.isNotNull(), F.array().cast("array<bigint>"))

    return make


@register_generator("uniform")
def _uniform(low: Any = 0.0, high: Any = 1.0) -> Generator:
    a, b = build(low), build(high)
    return lambda row: row.uniform() * (b(row.at("hi")) - a(row.at("lo"))) + a(row.at("lo"))


@register_generator("normal")
def _normal(mean: float = 0.0, deviation: float = 1.0) -> Generator:
    """Box-Muller on two draws."""
    return lambda row: F.lit(mean) + deviation * F.sqrt(-2 * F.log(1 - row.uniform(1))) * F.cos(2 * F.pi() * row.uniform(2))


@register_generator("exp")
def _exp(scale: float = 1.0) -> Generator:
    """Exponential; the argument is the scale (the mean)."""
    return lambda row: -scale * F.log(1 - row.uniform())


@register_generator("geom")
def _geom(p: float) -> Generator:
    """Trials up to the first success, from 1."""
    if not 0 < p <= 1:
        raise ValueError("geom needs 0 < p <= 1")
    import math

    return (lambda row: F.lit(1).cast("long")) if p == 1 else lambda row: F.greatest(F.ceil(F.log(1 - row.uniform()) / math.log(1 - p)), F.lit(1)).cast("long")


@register_generator("pareto")
def _pareto(a: float) -> Generator:
    """Lomax: (1 - u) ** (-1/a) - 1."""
    return lambda row: F.pow(1 - row.uniform(), F.lit(-1.0 / a)) - 1


@register_generator("int")
def _int(low: Any = 0, high: Any = 1 << 31) -> Generator:
    """Integers from low up to, not including, high."""
    a, b = build(low), build(high)
    return lambda row: (F.floor(row.uniform() * (b(row.at("hi")) - a(row.at("lo")))) + a(row.at("lo"))).cast("long")


def _cast(kind: str):
    def make(child: Any, *_: Any) -> Generator:
        g = build(child)
        return lambda row: g(row.at("x")).cast(kind)

    return make


register_generator("toint")(_cast("long"))
register_generator("todate")(_cast("date"))
register_generator("todatetime")(_cast("timestamp"))


@register_generator("todecimal")
def _todecimal(child: Any, precision: int = 38, scale: int = 18) -> Generator:
    g = build(child)
    return lambda row: g(row.at("x")).cast(f"decimal({precision},{scale})")


@register_generator("tobool")
def _tobool(child: Any) -> Generator:
    g = build(child)
    return lambda row: g(row.at("x")) != 0


@register_generator("tostring")
def _tostring(child: Any) -> Generator:
    g = build(child)
    return lambda row: g(row.at("x")).cast("string")


@register_generator("tobytes")
def _tobytes(child: Any) -> Generator:
    g = build(child)
    return lambda row: F.encode(g(row.at("x")).cast("string"), "utf-8")


@register_generator("choice")
def _choice(choices: list, weights: list[float] | None = None) -> Generator:
    """One of the specs, by weight."""
    gens = [build(c) for c in choices]
    w = weights or [1.0] * len(gens)
    if len(w) != len(gens) or not gens:
        raise ValueError("choice needs as many weights as choices")
    total, bounds, at = float(sum(w)), [], 0.0
    for x in w:
        at += x
        bounds.append(at / total)

    def make(row: Row) -> Column:
        u, out = row.uniform("choice"), gens[-1](row.at(f"c{len(gens) - 1}"))
        for k in range(len(gens) - 2, -1, -1):
            out = F.when(u < bounds[k], gens[k](row.at(f"c{k}"))).otherwise(out)
        return out

    return make


#: Letters of English text by frequency.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_FREQUENCY = [12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07]


@register_generator("str")
def _str(length: Any = 8, alphabet: str | None = None, weights: list[float] | None = None) -> Generator:
    """A string per row: each letter is looked up in a table of 4096 letters by weight."""
    n, letters = build(length), alphabet or LETTERS
    w = weights or (_FREQUENCY if alphabet is None else [1.0] * len(letters))
    total = float(sum(w))
    table, at = "", 0.0
    for c, x in zip(letters, w):
        at += x
        table += c * max(0, round(at / total * 4096) - len(table))

    def make(row: Row) -> Column:
        count = n(row.at("len")).cast("int")
        pick = lambda j: F.substring(F.lit(table), (F.pmod(row.hashed(j), F.lit(len(table))) + 1).cast("int"), F.lit(1))
        return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), count), pick), "")).when(count.isNotNull(), F.lit(""))

    return make


@register_generator("array")
def _array(child: Any, length: Any = 3) -> Generator:
    g, n = build(child), build(length)

    def make(row: Row) -> Column:
        count = n(row.at("len")).cast("int")
        items = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda j: g(row.at("e", salt=(*row.salt, j))))
        return F.when(count > 0, items).when(count.isNotNull(), F.slice(items, 1, 0))

    return make


register_generator("elem_array")(_array)


@register_generator("set")
def _set(child: Any, length: Any = 3) -> Generator:
    g = _array(child, length)
    return lambda row: F.array_distinct(g(row))


@register_generator("dict")
def _dict(key: Any, value: Any, length: Any = 3) -> Generator:
    """A map; of repeated keys the last wins."""
    k, v = _array(key, length), _array(value, length)

    def make(row: Row) -> Column:
        keys, values = k(row.at("k")), v(row.at("v"))
        n = F.least(F.size(keys), F.size(values))
        pairs = F.arrays_zip(F.slice(keys, 1, n).alias("k"), F.slice(values, 1, n).alias("v"))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(F.slice(keys, 1, n), i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x == p["k"]))
        return F.map_from_entries(last)

    return make


@register_generator("date")
def _date(start: Any, days: Any) -> Generator:
    s, d = build(start), build(days)
    return lambda row: F.date_add(s(row.at("start")).cast("date"), d(row.at("delta")).cast("int"))


@register_generator("datetime")
def _datetime(start: Any, seconds: Any) -> Generator:
    s, d = build(start), build(seconds)
    return lambda row: F.timestamp_micros(F.unix_micros(s(row.at("start")).cast("timestamp")) + (d(row.at("delta")) * 1000000).cast("long"))


@register_generator("concat")
def _concat(parts: list, separator: str = "") -> Generator:
    gens = [build(p) for p in parts]
    return lambda row: F.concat_ws(separator, *(g(row.at(f"p{i}")).cast("string") for i, g in enumerate(gens)))


@register_generator("format")
def _format(template: str, *args: Any) -> Generator:
    """{} and {:02d} of str.format, as %s and %02d."""
    values = args[0] if len(args) == 1 and isinstance(args[0], list) else list(args)
    gens = [build(a) for a in values]
    pattern = re.sub(r"\{(?::([^}]*))?\}", lambda m: "%" + (m.group(1) or "s"), template.replace("%", "%%"))
    return lambda row: F.format_string(pattern, *(g(row.at(f"a{i}")) for i, g in enumerate(gens)))


@register_generator("nested")
def _nested(fields: dict[str, Any]) -> Generator:
    gens = {k: build(v) for k, v in fields.items()}
    return lambda row: F.struct(*(g(row.at(k, siblings=gens)).alias(k) for k, g in gens.items()))


register_generator("dataframe")(_nested)


@register_generator("dataclass")
def _dataclass(fields: dict[str, Any], cls: type | None = None) -> Generator:
    return _nested(fields)


@register_generator("faker")
def _faker(name: str, locale: str = "en") -> Generator:
    return providers.provider(name, locale)


@register_generator("joint")
def _joint(child: Any, name: str = "joint", rows: Any = None) -> Generator:
    """A key shared by tables. Its owner makes child(i); with rows (how many the owner has) a random one of its keys."""
    g = build(child)
    place = f"/joint/{name}"
    if rows is None:
        return lambda row: g(replace(row, path=place))
    return lambda row: g(replace(row, path=place, salt=(), index=F.pmod(row.hashed("joint"), F.lit(rows)).cast("long")))


@register_generator("field")
def _field(name: str, default: Any = None, delta: int = 0) -> Generator:
    """The sibling field's value delta records back; default before the first record.

    The sibling is computed again at that index. A field that refers to itself has no such form and is refused."""
    other = build(default)

    def make(row: Row) -> Column:
        gens = row.siblings or {}
        if name not in gens:
            raise ValueError(f"no field {name} beside {row.path}")
        parent = row.path.rpartition("/")[0]
        if row.path == f"{parent}/{name}":
            raise ValueError(f"field {name} refers to itself")
        value = gens[name](replace(row, path=f"{parent}/{name}", index=row.index - delta))
        return F.when(row.index >= delta, value).otherwise(other(row.at("default"))) if delta else value

    return make


@register_generator("apply")
def _apply(function: Callable, children: list, kind: str = "string") -> Generator:
    """A Python function of generated values, in Arrow batches. Only callables are taken, never pickled text."""
    if not callable(function):
        raise ValueError("apply takes a function")
    gens = [build(c) for c in children]
    call = F.udf(function, kind, useArrow=True)
    return lambda row: call(*(g(row.at(f"x{i}")) for i, g in enumerate(gens)))
