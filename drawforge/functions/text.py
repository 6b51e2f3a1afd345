"""Column expressions on strings: trimming, delimited fields, dates and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as outer space: ASCII blanks, no-break spaces, byte order mark.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u202f\ufeff"


def strip(c: Column) -> Column:
    """`c` without outer blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def blank(c: Column) -> Column:
    """True for null and for text of blanks only."""
    return c.isNull() | (strip(c) == "")


def unquote(c: Column) -> Column:
    """Content of a quoted field: outer quotes off, doubled quotes single."""
    return F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` evaluated once however often `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Longer lines with quoted fields are folded instead of matched: Java's matcher recurses once per repeat.
MATCHED_UP_TO = 1000


def chomp(line: Column) -> Column:
    """`line` without line ends at its end."""
    return F.rtrim(line, F.lit("\r\n"))


def split_delimited(line: Column, sep: str = ";") -> Column:
    """Fields of one delimited line (already chomped) as array<string>; null for a null line or broken quoting.

    A field whose first character is a double quote runs to the next quote that is not doubled; where that is
    missing, or is not followed by the separator or the end, the quoting is broken. A quote anywhere else is an
    ordinary character. Lines without an opening quote take the plain split. In a line whose quotes all open or close
    a field the separators between quotes are masked before the split; other lines are matched, or, if very long,
    folded piece by piece. All ways have the same result.
    """
    field = f'(?:"(?:[^"]++|"")*+"(?={sep}|$)|[^"{sep}][^{sep}]*+|(?={sep}|$))'
    # a separator is put in front, or an empty first field would swallow the one behind it
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{sep}({field})"), F.lit(1))
    matched = F.when(
        line.rlike(f"^{field}(?:{sep}{field})*+$"),
        F.transform(found, lambda x: F.when(x.startswith('"'), unquote(x)).otherwise(x)),
    )
    quoted = F.when(F.length(line) <= MATCHED_UP_TO, matched).otherwise(_fold_quoted(line, sep))
    masked = let(F.split(line, '"', -1), lambda parts: _mask_quoted(parts, sep))
    plain = F.transform(F.split(masked, sep, -1), lambda x: F.when(x.contains(MASK), F.translate(x, MASK, sep)).otherwise(x))
    quoted = F.when(line.contains(MASK), quoted).otherwise(F.coalesce(plain, quoted))
    return F.when(line.startswith('"') | line.contains(sep + '"'), quoted).otherwise(F.split(line, sep, -1))


#: Stands for a separator inside quotes while a line is split.
MASK = "\x01"


def _mask_quoted(parts: Column, sep: str) -> Column:
    """The line whose pieces between quotes are `parts`, without the quotes and with the separators inside them masked;
    null unless every quote opens or closes a field."""

    def fits(x: Column, i: Column) -> Column:
        first, last = i == 0, i == F.size(parts) - 1
        edge = (first | last) & (x == "")
        return (i % 2 == 1) | edge | ((last | x.endswith(sep)) & (first | x.startswith(sep)))

    whole = (F.size(parts) % 2 == 1) & F.forall(F.transform(parts, fits), lambda x: x)
    masked = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, sep, MASK)).otherwise(x))
    return F.when(whole, F.array_join(masked, ""))


def _fold_quoted(line: Column, sep: str) -> Column:
    pieces = F.split(line, sep, -1)
    no_open = F.lit(None).cast("string")

    def made(fields: Column, open_: Column, broken: Column) -> Column:
        return F.struct(fields.alias("fields"), open_.alias("open"), broken.alias("broken"))

    def step(acc: Column, piece: Column) -> Column:
        opened = acc["open"].isNotNull()
        whole = F.when(opened, F.concat(acc["open"], F.lit(sep), piece)).otherwise(piece)
        inside = F.when(opened, piece).otherwise(F.substring(piece, F.lit(2), F.length(piece)))
        rest = F.replace(inside, F.lit('""'), F.lit(""))
        at = F.instr(rest, '"')
        return (
            F.when(acc["broken"], acc)
            .when(~opened & ~piece.startswith('"'), made(F.array_append(acc["fields"], piece), no_open, F.lit(False)))
            .when(at == 0, made(acc["fields"], whole, F.lit(False)))
            .when(at == F.length(rest), made(F.array_append(acc["fields"], unquote(whole)), no_open, F.lit(False)))
            .otherwise(made(acc["fields"], whole, F.lit(True)))
        )

    start = made(F.array().cast("array<string>"), no_open, F.lit(False))
    return F.aggregate(pieces, start, step, lambda a: F.when(~a["broken"] & a["open"].isNull(), a["fields"]))


def without_last_empty(line: Column, fields: Column, sep: str = ";") -> Column:
    """`fields` less the one empty field that a final separator leaves."""
    return F.when(line.endswith(sep), F.slice(fields, F.lit(1), F.greatest(F.size(fields) - 1, F.lit(0)))).otherwise(fields)


def real_date(c: Column, *patterns: str) -> Column:
    """The date that `c` writes in one of the exact forms; null where it is none or no real date.

    Forms: dd/MM/yyyy, yyyy-MM-dd, yyyyMMdd.
    """
    places = {"dd/MM/yyyy": (7, 4, 1), "yyyy-MM-dd": (1, 6, 9), "yyyyMMdd": (1, 5, 7)}
    shapes = {
        "dd/MM/yyyy": "^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
        "yyyy-MM-dd": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
        "yyyyMMdd": "^[0-9]{8}$",
    }
    found = F.lit(None).cast("date")
    for p in patterns or places:
        y, m, d = places[p]
        iso = F.concat_ws("-", F.substring(c, y, 4), F.substring(c, m, 2), F.substring(c, d, 2))
        # "\n" before the end would satisfy `$`; the length rules it out
        fits = c.rlike(shapes[p]) & (F.length(c) == len(p))
        found = F.when(fits, F.try_to_date(iso, "yyyy-MM-dd")).otherwise(found)
    return found
