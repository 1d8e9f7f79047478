"""Substitution with fake values (T3), built from literal dictionaries.

Two modes:

* ``random``: a fresh value per cell. Its draws are cut from SHA-256 of a row key
  (six to a digest, see ``draws``); without a key, of one random number drawn for
  the cell. ``name`` (the column) keeps columns independent.
* ``consistent``: the draws are cut from SHA-256 of the value itself, so equal
  inputs map to equal fakes (join-preserving pseudonyms) and the seed acts as the key.

Each generator is a pure ``Column`` expression (``element_at`` over array
literals, ``lpad``/``format_string`` for digit shapes); no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .draws import LANES, keyed_integer, with_key

# Fixed dictionaries for generated values (our own lists; any realistic words do).
FIRST_NAMES = [
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda",
    "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica",
    "Thomas", "Sarah", "Carlos", "Karen", "Ahmed", "Mei", "Olga", "Priya", "Kenji",
    "Fatima", "Lucas", "Sofia", "Noah", "Amara",
]
LAST_NAMES = [
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
    "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
    "Thomas", "Taylor", "Moore", "Jackson", "Martin", "Lee", "Perez", "Thompson",
    "White", "Harris", "Sanchez", "Clark", "Ramirez", "Lewis", "Robinson",
]
EMAIL_DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "test.example.org"]
STREET_NAMES = [
    "Main St", "Oak Ave", "Pine Rd", "Maple Dr", "Cedar Ln", "Elm St", "Birch Ct",
    "Spruce Way", "Walnut Blvd", "Ash Pl", "Lake View Rd", "Hill St", "River Rd", "Park Ave",
]
CITIES = [
    "Springfield", "Riverton", "Fairview", "Franklin", "Greenville", "Bristol", "Clinton",
    "Georgetown", "Salem", "Madison", "Oakland", "Lakewood", "Ashland", "Milton", "Dover",
]
COUNTRIES = [
    "Canada", "Mexico", "Brazil", "Argentina", "France", "Germany", "Spain", "Italy",
    "Norway", "Poland", "Kenya", "Egypt", "India", "Japan", "Australia", "Chile",
]
COMPANY_WORDS = [
    "Acme", "Globex", "Initech", "Umbrella", "Stark", "Wayne", "Vandelay", "Hooli",
    "Soylent", "Cyberdyne", "Tyrell", "Wonka", "Gringotts", "Oceanic", "Aperture",
]
COMPANY_SUFFIXES = ["Inc", "LLC", "Ltd", "Group", "and Sons", "PLC", "Corp"]
TLDS = ["com", "org", "net", "info", "biz"]
WORDS = [
    "alpha", "bridge", "candle", "delta", "ember", "forest", "garden", "harbor", "island",
    "jungle", "kettle", "lantern", "meadow", "nectar", "orbit", "pepper", "quartz",
    "river", "saddle", "timber", "umbra", "valley", "willow", "yonder", "zephyr",
]

SUBSTITUTE_TYPES = (
    "name", "email", "phone", "address", "company", "ssn", "credit_card", "date",
    "city", "country", "zipcode", "url", "ip", "text",
)


class _Draws:
    """Independent integer draws in [0, n), keyed by a row key or by the value itself."""

    def __init__(self, key: Column, seed: int, prefix: str):
        self.key, self.seed, self.prefix, self.drawn = key, seed, prefix, 0

    def __call__(self, n: int) -> Column:
        block, lane = divmod(self.drawn, LANES)
        self.drawn += 1
        return keyed_integer(self.key, self.seed, f"{self.prefix}{block}", n, lane)

    def pick(self, words: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), self(len(words)) + 1)

    def digits(self, k: int) -> Column:
        return F.lpad(self(10 ** k).cast("string"), k, "0")


def _luhn_card(d: _Draws) -> Column:
    """16-digit card number: 15 drawn digits plus the Luhn check digit."""
    body = [d(10) for _ in range(15)]
    total = F.lit(0)
    # positions counted from the right of the final number; the check digit is
    # position 1, so body digit j (0-based from the left) sits at 16 - j.
    for j, x in enumerate(body):
        pos = 16 - j
        if pos % 2 == 0:
            dbl = x * 2
            total = total + F.when(dbl > 9, dbl - 9).otherwise(dbl)
        else:
            total = total + x
    check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))
    return F.concat(*[x.cast("string") for x in body], check.cast("string"))


def substitute(c, data_type: str = "name", mode: str = "random", seed: int = 0, key: Column | None = None,
               name: str = "") -> Column:
    """Replace non-null values with a fake value of shape ``data_type``."""
    if mode not in ("random", "consistent"):
        raise ValueError("mode must be 'random' or 'consistent'")
    src = F.col(c) if isinstance(c, str) else c
    t = (data_type or "name").lower()
    if mode == "consistent":
        out = _fake(t, _Draws(src.cast(StringType()), seed, ""))
    else:
        out = with_key(key, seed, lambda k: _fake(t, _Draws(k, seed, f"{name}|")))
    # joined with nothing of the value, which is NULL where the value is: a branch would draw each digest anew
    return F.concat(out, F.substring(src.cast(StringType()), 1, 0))


def _fake(t: str, d: _Draws) -> Column:
    if t == "name":
        out = F.concat_ws(" ", d.pick(FIRST_NAMES), d.pick(LAST_NAMES))
    elif t == "email":
        out = F.concat(F.lower(d.pick(FIRST_NAMES)), F.lit("."), F.lower(d.pick(LAST_NAMES)),
                       d(100).cast("string"), F.lit("@"), d.pick(EMAIL_DOMAINS))
    elif t == "phone":
        out = F.format_string("(%d) %s-%s", d(800) + 200, d.digits(3), d.digits(4))
    elif t == "address":
        out = F.concat((d(9899) + 100).cast("string"), F.lit(" "), d.pick(STREET_NAMES),
                       F.lit(", "), d.pick(CITIES))
    elif t == "company":
        out = F.concat_ws(" ", d.pick(COMPANY_WORDS), d.pick(COMPANY_SUFFIXES))
    elif t == "ssn":
        out = F.format_string("%03d-%02d-%04d", d(899) + 1, d(99) + 1, d(9999) + 1)
    elif t == "credit_card":
        out = _luhn_card(d)
    elif t == "date":
        out = F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), d(365 * 66)), "yyyy-MM-dd")
    elif t == "city":
        out = d.pick(CITIES)
    elif t == "country":
        out = d.pick(COUNTRIES)
    elif t == "zipcode":
        out = d.digits(5)
    elif t == "url":
        out = F.concat(F.lit("https://www."), d.pick(WORDS), F.lit("."), d.pick(TLDS), F.lit("/"))
    elif t == "ip":
        out = F.concat_ws(".", *[d(256).cast("string") for _ in range(4)])
    elif t == "text":
        words = [d.pick(WORDS) for _ in range(8)]
        sentence = F.concat_ws(" ", *words)
        out = F.concat(F.upper(F.substring(sentence, 1, 1)), F.substring(sentence, 2, 10_000), F.lit("."))
    else:
        out = d.pick(WORDS)
    return out
