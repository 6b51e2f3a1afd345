"""Files whose schema drifts: one table in the layout of `tirages`, and every change of a file against the one before.

Rescue-column ingestion. `enforce` types the cells that the layout knows under their own name and keeps every other
cell, and every cell that cannot be cast, as JSON in `_rescued`; `promote` replays rescued values under approved
names into the typed columns. `ingest` does both in one pass over the rows (`replay`), without writing the JSON that
it would read again. The change report is made from the same pass: which cells were accepted or replayed into which
column, which were left, and how they were written, for every file and name, compared with the preceding file of its
family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import field_of
from ..functions.ordering import previous_by_blocks
from ..functions.text import let, strip
from ..schema import APPROVED, LAYOUT
from ..session import cut
from .rejects import ROW, parse_headers, separate

RESCUED = "_rescued"
#: A field has a type if this share of its non-empty values has it.
TYPE_SHARE = 0.8
_NAMES, _COLUMNS = list(LAYOUT), [col for col, _ in LAYOUT.values()]


#: How a value may be written; a kind is its number in this list, from 1.
KINDS = ["integer", "decimal", "date", "text"]
INTEGER, DECIMAL, DATE, TEXT = range(1, 5)


def kind_of(value: Column) -> Column:
    """The kind of one trimmed non-empty value."""
    date = value.rlike("^([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$")
    return (
        F.when(value.rlike("^[+-]?[0-9]+$"), INTEGER)
        .when(value.rlike("^[+-]?[0-9]+[,.][0-9]+$"), DECIMAL)
        .when(date, DATE)
        .otherwise(TEXT)
    )


#: Types of the layout by number; integers of up to nine digits are in the range of all that are not strings.
TYPES = ["string", "double", "bigint", "int"]
STRING, DOUBLE, BIGINT, INT = range(4)
ANY_RANGE = 9


def accepted_text(value: Column, written: Column, kind: Column) -> Column:
    """`value`, which is not empty, as a plain cast to the layout's type `kind` takes it; null where it cannot be cast
    without loss.

    `written` is `kind_of(value)`. Numbers may be grouped in threes by a blank and have a comma or point; strings keep
    what is written.
    """
    ungrouped = F.regexp_replace(value, "(?<=[0-9])[ \\u00a0\\u202f](?=[0-9]{3}([^0-9]|$))", "")
    plain = F.translate(ungrouped, ",", ".")
    number = (
        F.when(written == INTEGER, value)
        .when(written == DECIMAL, F.translate(value, ",", "."))
        .otherwise(F.when(plain.rlike("^[+-]?[0-9]+([.][0-9]+)?$"), plain))
    )
    whole = F.when(written == INTEGER, value).otherwise(let(F.regexp_replace(plain, "[.]0+$", ""), lambda t: F.when(t.rlike("^[+-]?[0-9]+$"), t)))
    return (
        F.when((kind == STRING) | (written == INTEGER) & (F.length(value) <= ANY_RANGE), value)
        .when(kind == DOUBLE, number)
        .when(kind == INT, F.when(whole.try_cast("int").isNotNull(), whole))
        .otherwise(F.when(whole.try_cast("bigint").isNotNull(), whole))
    )


def lenient_text(value: Column, written: Column, kind: Column) -> Column:
    """`accepted_text`, or for numbers that of the only number in the text ("4 codes", "2,20 EUR")."""
    lead = strip(F.regexp_extract(value, "^[^0-9]*?([+-]?[0-9][0-9 \\u00a0\\u202f]*([.,][0-9]+)?)[^0-9]*$", 1))
    inner = let(lead, lambda v: accepted_text(v, kind_of(v), kind))
    return F.when(value != "", F.coalesce(accepted_text(value, written, kind), F.when(kind != STRING, inner)))


def lenient(value: Column, kind: str) -> Column:
    """The value in the layout's type by `lenient_text`."""
    return lenient_text(value, kind_of(value), F.lit(TYPES.index(kind))).try_cast(kind)


def header_plan(headers: DataFrame, approved: dict[str, list[str]] | None = None) -> DataFrame:
    """`headers` with, for each field of the layout, `own`: the place of its exact name (null for none), and
    `replays`: the places whose rescued values it may take, its own first, then other names that stand for it
    (approved ones and those of the same words) in the order of the file. Names with a place added are never replayed.
    """
    layout = F.array(*[F.lit(n) for n in _NAMES])
    if approved is not None:
        headers = headers.withColumn("meant", F.transform("names", lambda n: field_of(n, approved)))
    own = F.transform(layout, lambda n: F.nullif(F.array_position("keys", n), F.lit(0)).cast("int"))
    other = F.filter(
        F.transform("keys", lambda k, i: F.struct((i + 1).alias("place"), k.alias("key"), F.get("meant", i).alias("meant"))),
        lambda p: (p["key"] != p["meant"]) & ~p["key"].contains("#"),
    )
    headers = headers.withColumn("own", own).withColumn("_other", other)
    of = lambda n: F.transform(F.filter("_other", lambda p: p["meant"] == n), lambda p: p["place"])
    replays = F.transform(layout, lambda n, i: F.concat(F.array_compact(F.array(F.get("own", i))), of(n)))
    return headers.withColumn("replays", replays).drop("_other")


def _at(values: str, place: Column) -> Column:
    return F.get(values, place - 1)


def _kind(i: Column) -> Column:
    """The type of the i-th field of the layout, from 0."""
    return F.get(F.array(*[F.lit(TYPES.index(kind)) for _, kind in LAYOUT.values()]), i)


def typed_cells(clean: DataFrame) -> DataFrame:
    """`clean` with `written` (kind of each cell, null for an empty one) and `accepted`: for each field of the layout
    the text of the cell under its own name, null where there is none or it cannot be cast."""
    rows = clean.withColumn("written", F.transform("cells", lambda v: F.when(v != "", kind_of(v))))
    strict = lambda p, i: accepted_text(_at("cells", p), _at("written", p), _kind(i))
    return rows.withColumn("accepted", F.transform("own", lambda p, i: F.when(_at("written", p).isNotNull(), strict(p, i))))


def replay(typed: DataFrame) -> DataFrame:
    """`typed_cells` with `taken`: for each field of the layout the place of the cell that its column holds.

    That is the accepted cell, else the first rescued one of `replays` that can be cast, numbers in text included;
    null where there is none.
    """
    here = lambda p, i: lenient_text(_at("cells", p), _at("written", p), _kind(i)).isNotNull()
    first = lambda i: F.get(F.filter(F.get("replays", i), lambda p: _at("written", p).isNotNull() & here(p, i)), F.lit(0))
    return typed.withColumn("taken", F.transform("accepted", lambda a, i: F.when(a.isNotNull(), F.get("own", i)).otherwise(first(i))))


def _table(rows: DataFrame, texts: Column, taken: Column) -> DataFrame:
    """The layout's typed columns from `texts`, and as JSON the non-empty cells whose place is not in `taken`."""
    places = F.filter(F.array_except(F.sequence(F.lit(1), F.size("cells")), taken), lambda p: _at("written", p).isNotNull())
    left = F.transform(places, lambda p: F.struct(_at("keys", p).alias("key"), _at("cells", p).alias("value")))
    rows = rows.select(*ROW, texts.alias("_texts"), left.alias("_left"))
    typed = [F.get("_texts", F.lit(i)).try_cast(kind).alias(col) for i, (col, kind) in enumerate(LAYOUT.values())]
    return rows.select(*ROW, *typed, F.when(F.size("_left") > 0, F.to_json(F.map_from_entries("_left"))).alias(RESCUED))


def enforce(clean: DataFrame) -> DataFrame:
    """Clean rows (of `separate` with `header_plan`) in the layout of `tirages`, each column typed, the other cells in
    `_rescued`.

    Only exact names of the layout are accepted here. `_rescued` is a JSON object of name -> text of all non-empty
    cells with an unknown name or a value that cannot be cast; null where there are none. A name that comes again
    in a header is unknown there, with its place added to the name.
    """
    taken = F.transform("accepted", lambda a, i: F.when(a.isNotNull(), F.get("own", i)))
    return _table(typed_cells(clean), F.col("accepted"), taken)


def _best(others: str, name: str, kind: str) -> Column:
    """Of `others`(field, key, value) the first that stands for `name` and can be cast; that of the name itself first."""
    here = F.filter(others, lambda e: (e["field"] == name) & lenient(e["value"], kind).isNotNull())
    own = F.filter(here, lambda e: e["key"] == name)
    return F.coalesce(F.get(own, F.lit(0)), F.get(here, F.lit(0)))


def promote(table: DataFrame, approved: dict[str, list[str]] | None = None) -> DataFrame:
    """Replays rescued values into the typed columns they are approved for.

    A column that is still null takes the first castable value of its own name, else of the names that stand for it
    (approved ones and those of the same words), in the order of the file; numbers in text included. What was taken
    leaves `_rescued`. Columns that hold a value keep it; names with a place added are never replayed.
    """
    approved = APPROVED if approved is None else approved
    df = table.withColumn("_r", F.from_json(RESCUED, "map<string,string>"))
    others = F.filter(F.map_entries("_r"), lambda e: ~e["key"].contains("#"))
    df = df.withColumn(
        "_o", F.transform(others, lambda e: F.struct(field_of(e["key"], approved).alias("field"), e["key"].alias("key"), e["value"].alias("value")))
    )
    values, taken = [], []
    for name, (col, kind) in LAYOUT.items():
        best = _best("_o", name, kind)
        # most rows have nothing rescued: they keep their value without a search
        df = df.withColumn(f"_b_{col}", F.when(F.col(col).isNull() & F.col("_r").isNotNull(), best))
        values.append(F.coalesce(col, lenient(F.col(f"_b_{col}")["value"], kind)).alias(col))
        taken.append(F.col(f"_b_{col}")["key"])
    df = df.withColumn("_taken", F.array_compact(F.array(*taken)))
    left = F.map_filter("_r", lambda n, v: ~F.array_contains(F.col("_taken"), n))
    return df.select("file_no", "row_no", *values, F.when(F.size(left) > 0, F.to_json(left)).alias(RESCUED))


def planned_headers(lines: DataFrame, approved: dict[str, list[str]] | None = None) -> DataFrame:
    """The headers of the files with their plan, checkpointed."""
    return cut(header_plan(parse_headers(lines), approved))


def ingest(lines: DataFrame, approved: dict[str, list[str]] | None = None) -> DataFrame:
    """One table in the layout of `tirages` from all rows that can be loaded: `promote(enforce(...))` in one pass."""
    text = lambda p, i: lenient_text(_at("cells", p), _at("written", p), _kind(i))
    texts = F.transform("taken", lambda p, i: F.coalesce(F.get("accepted", i), text(p, i)))
    clean, _ = separate(lines, planned_headers(lines, approved))
    return _table(replay(typed_cells(clean)), texts, F.col("taken"))


def written_kinds(replayed: DataFrame) -> DataFrame:
    """(file_no, place, took, n, integer, decimal, date): how the cells of every file and place were written, accepted,
    replayed and left ones alike, and the layout's field (numbered from 1) that took them; 0 where none did."""
    # many rows of a file are written alike: they are counted before their cells are told apart
    alike = replayed.groupBy("file_no", "written", "taken").agg(F.count(F.lit(1)).alias("rows"))
    cell = F.transform("written", lambda w, i: F.struct(w.alias("kind"), F.array_position("taken", i + 1).alias("took")))
    # an outer explode, as an inner one would first filter by the array and so make it twice
    cells = alike.select("file_no", "rows", F.posexplode_outer(cell).alias("place", "c")).select("*", "c.*").filter("kind is not null")
    written = lambda i: F.coalesce(F.sum(F.when(F.col("kind") == i, F.col("rows"))), F.lit(0))
    return cells.groupBy("file_no", "place").agg(
        F.max("took").cast("int").alias("took"), F.sum("rows").alias("n"), *[written(i).alias(KINDS[i - 1]) for i in (INTEGER, DECIMAL, DATE)]
    )


def file_fields(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(file_no, field, name, kind): the fields of every file that has a header.

    `field` is the column of the layout that the name's values are accepted or replayed into; of a name without such
    values, what the header's plan promotes it to. A second name for a field that the file already has is a field of
    its own, and a name that comes twice counts once. An empty last name is no field. `kind` is the type of at least
    TYPE_SHARE of the non-empty values in loadable rows, else text; null if there are no values.
    """
    kinds = written_kinds(replay(typed_cells(separate(lines, headers)[0])))
    fields = headers.select("file_no", "n_names", "names", "meant", F.posexplode(F.arrays_zip("names", "meant")).alias("pos", "f")).select(
        "file_no",
        F.col("pos").alias("place"),
        F.col("f.names").alias("name"),
        F.col("f.meant").alias("meant"),
        (F.array_position("meant", F.col("f.meant")) == F.col("pos") + 1).alias("_means"),
        ((F.col("f.names") == "") & (F.col("pos") + 1 == F.col("n_names"))).alias("_none"),
        (F.array_position("names", F.col("f.names")) == F.col("pos") + 1).alias("_first"),
    )
    fields = fields.filter(~F.col("_none") & F.col("_first")).drop("_none", "_first")
    kind = F.when(F.col("n").isNull(), None)
    for k in KINDS[:-1]:
        kind = kind.when(F.col(k) >= TYPE_SHARE * F.col("n"), k)
    took = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.nullif("took", F.lit(0)) - 1)
    field = F.when(F.col("_means"), F.coalesce(took, "meant")).otherwise(F.col("name"))
    return fields.join(kinds, ["file_no", "place"], "left").select("file_no", field.alias("field"), "name", kind.otherwise(KINDS[-1]).alias("kind"))


def changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_no, field_name, change_kind) of each file with lines against the preceding one of its family.

    added, removed, renamed and retyped as described in the module; a field that is renamed and retyped gives two
    rows. The first file of a family has no rows. Files without lines are passed over; a file of `lines` that
    `files` does not know has no family and no rows; a null family is a family like any other.
    """
    headers = planned_headers(lines)
    known = files.groupBy("file_no").agg(F.first("famille").alias("famille"))
    chain = previous_by_blocks(known.join(headers.select("file_no"), "file_no"), ["famille"], "file_no", "before")
    # the fields of a file are compared twice: as its own, and as those before the next one
    sides = F.array(F.struct(F.col("file_no").alias("of"), F.lit(True).alias("is_now")), F.struct(F.col("before").alias("of"), F.lit(False).alias("is_now")))
    sides = chain.filter("before is not null").select("file_no", F.explode(sides).alias("s")).select("file_no", "s.*")
    both = sides.join(file_fields(lines, headers).withColumnRenamed("file_no", "of"), "of")
    side = lambda col, is_now: F.max(F.when(F.col("is_now") == is_now, F.col(col)))
    both = both.groupBy("file_no", "field").agg(
        side("name", True).alias("name"),
        side("kind", True).alias("kind"),
        side("name", False).alias("old_name"),
        side("kind", False).alias("old_kind"),
    )
    change = F.array_compact(
        F.array(
            F.when(F.col("old_name").isNull(), "added"),
            F.when(F.col("name").isNull(), "removed"),
            F.when(F.col("name") != F.col("old_name"), "renamed"),
            F.when(F.col("kind") != F.col("old_kind"), "retyped"),
        )
    )
    return both.select(
        "file_no", F.coalesce("name", "old_name").alias("field_name"), F.explode(change).alias("change_kind")
    )
