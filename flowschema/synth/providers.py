"""Names, places and the like from small tables, by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EN = {
    "first_name": "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen".split(),
    "last_name": "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin".split(),
    "city": "Springfield Riverton Fairview Madison Georgetown Arlington Ashland Clinton Dover Franklin Greenville Kingston Milton Newport Oxford Salem Winchester".split(),
    "state": "Alabama Alaska Arizona California Colorado Florida Georgia Illinois Kansas Maine Nevada Ohio Oregon Texas Utah Virginia Washington".split(),
    "street": "Oak Maple Cedar Elm Main Lake Hill Park River Spring".split(),
    "company": "Acme Globex Initech Umbrella Stark Wayne Hooli Vandelay Wonka Cyberdyne".split(),
    "job": "Engineer Nurse Teacher Analyst Chef Driver Editor Farmer Lawyer Pilot".split(),
    "word": "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system".split(),
    "country": "Canada Mexico Brazil France Germany Spain Italy India Japan Kenya Norway Poland".split(),
}
_DE = _EN | {"first_name": "Anna Ben Clara David Emma Felix Greta Hans Ida Jonas".split(), "last_name": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann".split(), "city": "Berlin Hamburg München Köln Bremen Leipzig Dresden Kassel".split()}
LOCALES = {"en": _EN, "de": _DE}


def provider(name: str, locale: str = "en"):
    """A generator of the named kind of value."""
    table = LOCALES[locale.split("_")[0].lower()]

    def one(row, kind: str, tag: str = "") -> Column:
        words = table[kind]
        return F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(row.hashed(kind, tag), F.lit(len(words))) + 1).cast("int"))

    def digits(row, n: int, tag: str) -> Column:
        return F.lpad(F.pmod(row.hashed(tag), F.lit(10**n)).cast("string"), n, "0")

    made = {
        "name": lambda r: F.concat_ws(" ", one(r, "first_name"), one(r, "last_name")),
        "street_address": lambda r: F.concat(digits(r, 3, "no"), F.lit(" "), one(r, "street"), F.lit(" Street")),
        "address": lambda r: F.concat(digits(r, 3, "no"), F.lit(" "), one(r, "street"), F.lit(" Street, "), one(r, "city")),
        "email": lambda r: F.concat(F.lower(one(r, "first_name")), F.lit("."), F.lower(one(r, "last_name")), digits(r, 3, "mail"), F.lit("@example.com")),
        "phone_number": lambda r: F.concat(F.lit("555-"), digits(r, 3, "p1"), F.lit("-"), digits(r, 4, "p2")),
        "zipcode": lambda r: digits(r, 5, "zip"),
        "postcode": lambda r: digits(r, 5, "zip"),
        "ssn": lambda r: F.concat_ws("-", digits(r, 3, "s1"), digits(r, 2, "s2"), digits(r, 4, "s3")),
        "uuid4": lambda r: F.regexp_replace(F.md5(r.hashed("uuid").cast("string")), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-4$3-8$4-$5"),
        "sentence": lambda r: F.concat(F.initcap(one(r, "word", "1")), *(F.concat(F.lit(" "), one(r, "word", str(i))) for i in range(2, 8)), F.lit(".")),
        "url": lambda r: F.concat(F.lit("https://"), F.lower(one(r, "company")), F.lit(".example.com/"), digits(r, 4, "u")),
        "user_name": lambda r: F.concat(F.lower(one(r, "last_name")), digits(r, 3, "user")),
    }
    if name in made:
        return made[name]
    if name in table:
        return lambda r: one(r, name)
    raise ValueError(f"unknown provider {name}")
