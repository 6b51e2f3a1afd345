"""Names of fields: cleaning, and the field of the layout that a name stands for."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import APPROVED, LAYOUT
from .text import strip

#: Written-out forms of words that are shortened in names, and words without weight.
SHORT = {"nb": "nombre", "nbre": "nombre", "nombres": "nombre", "num": "numero", "no": "numero", "rg": "rang"}
WEIGHTLESS = {"de", "du", "des", "au", "en", "la", "le", "les", "d", "l"}


def clean_name(c: Column) -> Column:
    """Lower case, without byte order mark, quotes and outer blanks."""
    return strip(F.lower(strip(F.regexp_replace(c, '[\ufeff"]', ""))))


def word_key(name: str) -> str:
    """The words of a name in one spelling: accents off, short forms written out, plural s off, small words out."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(x))
    words = (SHORT.get(w, w) for w in re.findall(r"[a-z]+|[0-9]+", plain))
    return " ".join(sorted(re.sub("s$", "", w) for w in words if w not in WEIGHTLESS))


def _dictionary(approved: dict[str, list[str]]) -> tuple[dict[str, str], dict[str, str]]:
    exact = {f: f for f in LAYOUT} | {a: f for f, names in approved.items() for a in names}
    keys: dict[str, set[str]] = {}
    for name, field in exact.items():
        keys.setdefault(word_key(name), set()).add(field)
    return exact, {k: min(fields) for k, fields in keys.items() if len(fields) == 1}


def _lookup(pairs: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def column_key(c: Column) -> Column:
    """`word_key` as a column expression."""
    plain = F.translate(c, "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")
    words = F.regexp_extract_all(plain, F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    full = F.transform(words, lambda w: F.coalesce(_lookup(SHORT, w), w))
    heavy = F.filter(full, lambda w: ~w.isin(*sorted(WEIGHTLESS)))
    return F.array_join(F.array_sort(F.transform(heavy, lambda w: F.regexp_replace(w, "s$", ""))), " ")


def field_of(name: Column, approved: dict[str, list[str]] | None = None) -> Column:
    """The layout's field that a cleaned name stands for; a name that stands for none is its own field.

    First the approved names as they are, then names made of the same words ("nbre_codes_gagnants").
    """
    exact, keys = _dictionary(APPROVED if approved is None else approved)
    return F.coalesce(_lookup(exact, name), _lookup(keys, column_key(name)), name)


def cell_keys(names: Column) -> Column:
    """The names of a header made unique: one that comes again, or has a "#" itself, gets its place added."""
    return F.transform(
        names,
        lambda n, i: F.when((F.array_position(names, n) == i + 1) & ~n.contains("#"), n).otherwise(F.concat_ws("#", n, (i + 1).cast("string"))),
    )
