"""Registered queries of the table-quality operators (problems 2 to 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, profile, rejects, units
from ..schema import LAYOUT
from ..sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.changes(table(spark, root, "csv_lines"), table(spark, root, "csv_files")).select(
        F.col("file_no").cast("int").alias("file_no"), "field_name", "change_kind"
    )


def p2_table(spark: SparkSession, root: str) -> DataFrame:
    """All loadable rows of all files in the layout of `tirages`, rescued cells as JSON."""
    return drift.ingest(table(spark, root, "csv_lines"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    all_ = units.in_cents(*(table(spark, root, t) for t in ("payout_reports", "sources", "tirages")))
    cases = all_.filter(F.col("positive") & (F.col("unit") != units.PLAIN))
    return cases.select("src_table", F.col("row_id").cast("long").alias("row_id"), "rang", "cents")


def p3_converted(spark: SparkSession, root: str) -> DataFrame:
    """Every readable figure with its unit and its value in euro cents."""
    all_ = units.in_cents(*(table(spark, root, t) for t in ("payout_reports", "sources", "tirages")))
    return all_.select("src_table", "row_id", "rang", "unit", "cents")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    _, bad = rejects.separate(table(spark, root, "csv_lines"))
    return bad.select(F.col("file_no").cast("int").alias("file_no"), F.col("row_no").cast("long").alias("row_no"), "reason")


def p4_clean(spark: SparkSession, root: str) -> DataFrame:
    """The rows that can be loaded, with their number of cells."""
    clean, _ = rejects.separate(table(spark, root, "csv_lines"))
    return clean.select("file_no", "row_no", F.size("cells").alias("n_cells"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = profile.profile_loads(table(spark, root, "tirages"), "load_no", list(profile.TIRAGES_LIMITS))
    return profile.issues(found).select(F.col("load").cast("int").alias("load_no"), F.col("field").alias("field_name"), "issue")


def p5_profile(spark: SparkSession, root: str) -> DataFrame:
    """The profile of every column of `tirages` but the load number in every load, with its comparison to the last.

    Rows less nulls and distinct values are repeats (of ids, say); low and high of loaded_at are seconds since 1970.
    """
    tirages = table(spark, root, "tirages")
    fields = [c for c in tirages.columns if c != "load_no"]
    found = profile.profile_loads(tirages, "load_no", fields)
    return found.select(
        F.col("load").alias("load_no"),
        F.col("field").alias("field_name"),
        "rows",
        "nulls",
        "n_distinct",
        "distinct_before",
        "low",
        "high",
        "bad",
        "outside",
        "moved",
        F.round("psi", 6).alias("psi"),
        F.round("chi2", 6).alias("chi2"),
    )


ORACLE: dict[str, str] = {}

QUERIES = {f.__name__: f for f in (p2_found, p2_table, p3_found, p3_converted, p4_found, p4_clean, p5_found, p5_profile)}

_FIELD = """("(?:[^"]|"")*"|[^";][^;]*|)"""
#: rows(file_no, row_no, cells), names(file_no, pos, name, field), rej(file_no, row_no, reason) over csv_lines.
_ROWS = f"""
with h as (select file_no, regexp_replace(line, '^\ufeff', '') as line from csv_lines where row_no = 0),
hn as (select file_no, list_transform(regexp_extract_all(';' || line, ';{_FIELD}', 1), lambda x: trim(lower(replace(trim(x), '"', '')))) as ns, line from h),
hd as (select file_no, case when line like '%;' then ns[1:len(ns) - 1] else ns end as ns from hn),
al as (select * from (values {{aliases}}) t(name, field)),
names as (select file_no, pos, name, coalesce(field, name) as field from (select file_no, unnest(ns) as name, unnest(range(1, len(ns) + 1)) as pos from hd) left join al using (name)),
r0 as (select file_no, row_no, line, regexp_full_match(line, '{_FIELD}(;{_FIELD})*') as ok from csv_lines where row_no > 0 and trim(line) <> ''),
r1 as (select *, list_transform(regexp_extract_all(';' || line, ';{_FIELD}', 1), lambda x: trim(case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end, ' \u00a0')) as c from r0 where ok),
rows as (select file_no, row_no, case when line like '%;' then c[1:len(c) - 1] else c end as cells from r1),
whole as (select rows.*, ns from rows join hd using (file_no) where len(cells) = len(ns)),
cell as (select file_no, row_no, field, cells[pos] as v from whole join names using (file_no)),
bad as (select file_no, row_no,
  bool_or(field = 'annee_numero_de_tirage' and not (regexp_full_match(v, '[0-9]{{{{11}}}}') and coalesce(try_cast(substr(v, 1, 4) as int) between 1976 and 2025, false))) as key,
  bool_or(field = 'nombre_de_gagnant_au_rang1' and not regexp_full_match(v, '([0-9]+|[0-9]{{{{1,3}}}}([ \u00a0][0-9]{{{{3}}}})+)?'))
  or bool_or(field = 'rapport_du_rang1' and not regexp_full_match(v, '(([0-9]+|[0-9]{{{{1,3}}}}([ \u00a0][0-9]{{{{3}}}})+)([,.][0-9]+)?)?'))
  or bool_or(field like 'boule\\__' escape '\\' and not coalesce(try_cast(case when regexp_full_match(v, '[0-9]+') then v end as int) between 1 and 49, false))
  or bool_or(field = 'numero_chance' and not coalesce(try_cast(case when regexp_full_match(v, '[0-9]+') then v end as int) between 1 and 10, false))
  or count(*) filter (field like 'boule\\__' escape '\\') > count(distinct try_cast(v as int)) filter (field like 'boule\\__' escape '\\')
  or bool_or(field = 'date_de_tirage' and coalesce(case when regexp_full_match(v, '[0-9]{{{{2}}}}/[0-9]{{{{2}}}}/[0-9]{{{{4}}}}') then try_strptime(v, '%d/%m/%Y')
     when regexp_full_match(v, '[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}') then try_strptime(v, '%Y-%m-%d') when regexp_full_match(v, '[0-9]{{{{8}}}}') then try_strptime(v, '%Y%m%d') end) is null) as val
  from cell group by 1, 2),
rej as (select file_no, row_no, 'quoting' as reason from r0 where not ok
  union all select file_no, row_no, 'column_count' from rows left join hd using (file_no) where len(cells) is distinct from len(ns)
  union all select file_no, row_no, case when key then 'bad_key' else 'bad_value' end from bad where key or val)"""
#: Names in the files and the fields they stand for, written out for SQL.
_NAMES = """('date_forclusion', 'date_de_forclusion'), ('forclusion', 'date_de_forclusion'), ('num_chance', 'numero_chance'), ('no_chance', 'numero_chance'),
  ('combinaison_croissante', 'combinaison_gagnante_en_ordre_croissant'), ('combinaison_gagnante', 'combinaison_gagnante_en_ordre_croissant'),
  ('gagnant_rg5', 'nombre_de_gagnant_au_rang5'), ('gagnants_rang5', 'nombre_de_gagnant_au_rang5'), ('nb_gagnants_rang_5', 'nombre_de_gagnant_au_rang5'),
  ('nombre_de_gagnants_au_rang_5', 'nombre_de_gagnant_au_rang5'), ('nombre_gagnants_rang5', 'nombre_de_gagnant_au_rang5'), ('rapport_rang3', 'rapport_du_rang3'), ('gain_rang3', 'rapport_du_rang3'),
  ('nombre_codes_gagnants', 'nombre_de_codes_gagnants'), ('nombre_de_codes', 'nombre_de_codes_gagnants'), ('nombre_codes', 'nombre_de_codes_gagnants'), ('nb_codes_gagnants', 'nombre_de_codes_gagnants'),
  ('nb_codes', 'nombre_de_codes_gagnants'), ('num_jokerplus', 'numero_jokerplus'), ('no_joker+', 'numero_jokerplus'), ('numero_joker_plus', 'numero_jokerplus'), ('joker_plus', 'numero_jokerplus'),
  ('jokerplus', 'numero_jokerplus'), ('code_devise', 'devise'), ('monnaie', 'devise')"""
_ROWS = _ROWS.replace("{{", "{").replace("}}", "}").replace("{aliases}", _NAMES)
ORACLE["p4_found"] = f"{_ROWS} select file_no, row_no, reason from rej"
ORACLE["p4_clean"] = f"{_ROWS} select file_no, row_no, len(cells)::int as n_cells from rows anti join rej using (file_no, row_no)"
ORACLE["p2_found"] = f"""{_ROWS},
vals as (select file_no, pos, cells[pos] as v from (select * from rows anti join rej using (file_no, row_no)) join names using (file_no) where cells[pos] <> ''),
kd as (select file_no, pos, case when avg(regexp_full_match(v, '[+-]?[0-9]+')::int) >= 0.8 then 'integer' when avg(regexp_full_match(v, '[+-]?[0-9]+[,.][0-9]+')::int) >= 0.8 then 'decimal'
  when avg(regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::int) >= 0.8 then 'date' else 'text' end as kind from vals group by 1, 2),
fl as (select n.file_no, field, name, kind from names n left join kd using (file_no, pos) where not (name = '' and pos = (select len(ns) from hd where hd.file_no = n.file_no))),
ch as (select file_no, lag(file_no) over (partition by famille order by file_no) as before from csv_files where file_no in (select file_no from csv_lines)),
nw as (select c.file_no, field, name, kind from ch c join fl using (file_no) where before is not null),
od as (select c.file_no, field, name, kind from ch c join fl on fl.file_no = c.before),
bo as (select coalesce(nw.file_no, od.file_no) as file_no, nw.name, nw.kind, od.name as oname, od.kind as okind from nw full join od on nw.file_no = od.file_no and nw.field = od.field)
select file_no, name as field_name, 'added' as change_kind from bo where oname is null
union all select file_no, oname, 'removed' from bo where name is null
union all select file_no, name, 'renamed' from bo where name <> oname
union all select file_no, name, 'retyped' from bo where kind <> okind"""

_NUMBER = "[+-]?[0-9]+([ \u00a0\u202f][0-9]{3})*([.,][0-9]+([ \u00a0\u202f][0-9]{3})*)?"
_CASTS = {"bigint": "bigint", "int": "int", "double": "double", "string": "varchar"}


def _text(v: str) -> str:
    """`v` as it is cast to the type `kind`, null where it cannot be."""
    number = f"case when regexp_full_match({v}, '{_NUMBER}') then replace(regexp_replace({v}, '[ \u00a0\u202f]', '', 'g'), ',', '.') end"
    whole = f"regexp_replace({number}, '[.]0+$', '')"
    return f"""case kind when 'string' then {v} when 'double' then {number} when 'int' then case when try_cast(case when {whole} not like '%.%' then {whole} end as int) is not null then {whole} end
    else case when try_cast(case when {whole} not like '%.%' then {whole} end as bigint) is not null then {whole} end end"""


_INNER = "trim(regexp_extract(v, '^[^0-9]*?([+-]?[0-9][0-9 \u00a0\u202f]*([.,][0-9]+)?)[^0-9]*$', 1), ' \u00a0')"
ORACLE["p2_table"] = f"""{_ROWS},
lay as (select * from (values {", ".join(f"('{n}', '{kind}')" for n, (_, kind) in LAYOUT.items())}) t(field, kind)),
uni as (select *, case when row_number() over (partition by file_no, name order by pos) = 1 and name not like '%#%' then name else name || '#' || pos end as key from names),
cl as (select file_no, row_no, pos, key, field, cells[pos] as v from (select * from rows anti join rej using (file_no, row_no)) join uni using (file_no) where cells[pos] <> ''),
may as (select *, coalesce({_text("v")}, case when kind <> 'string' then {_text(_INNER)} end) as t, {_text("v")} as own from cl join lay using (field) where key not like '%#%'),
won as (select * from may where t is not null qualify row_number() over (partition by file_no, row_no, field order by key <> field, pos) = 1),
val as (select file_no, row_no, {", ".join(f"cast(max(t) filter (field = '{n}') as {_CASTS[kind]}) as {col}" for n, (col, kind) in LAYOUT.items())} from won group by 1, 2),
res as (select file_no, row_no, '{{' || string_agg(to_json(key)::varchar || ':' || to_json(v)::varchar, ',' order by pos) || '}}' as _rescued from cl anti join won using (file_no, row_no, pos) group by 1, 2)
select val.*, _rescued from val left join res using (file_no, row_no)"""

#: fig(src_table, row_id, rang, v, unit): figures above 0 with their unit, by rules written out for SQL.
_FIGURES = """
with u as (select rec_id, year, source_code, trim(devise) as devise, rang, trim(t, ' \u00a0') as t from (
  select rec_id, substr(trim(annee_numero), 1, 4)::int as year, source_code, devise, 1 as rang, rapport_du_rang1 as t from payout_reports
  union all select rec_id, substr(trim(annee_numero), 1, 4)::int, source_code, devise, 2, rapport_du_rang2 from payout_reports)),
p as (select *, regexp_extract(t, '^([^0-9]*)([0-9][0-9 .,\u00a0]*[0-9]|[0-9])([^0-9]*)$', 2) as num,
  trim(regexp_extract(t, '^([^0-9]*)([0-9][0-9 .,\u00a0]*[0-9]|[0-9])([^0-9]*)$', 1) || regexp_extract(t, '^([^0-9]*)([0-9][0-9 .,\u00a0]*[0-9]|[0-9])([^0-9]*)$', 3), ' \u00a0') as w from u),
q as (select *, regexp_replace(num, '[ \u00a0]', '', 'g') as d from p where num <> ''),
n as (select *, (case when regexp_full_match(d, '[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?') then replace(replace(d, '.', ''), ',', '.') else replace(d, ',', '.') end)::decimal(24, 6) as v from q),
nt as (select source_code, year, case
  when note like '%anciens francs%' then 'AF' when note like 'Avant 2002 en francs%' or note like 'Francs jusqu''au 31/12/2001%' then case when year < 2002 then 'FRF' else 'EUR' end
  when note like 'En centimes d''euro depuis le 01/01/2005%' then case when year >= 2005 then 'cEUR' else 'EUR' end
  when note like '%FRF%' or note like '%francs%' then 'FRF' when note like '%k€%' or note like '%milliers d''euros%' then 'kEUR' when note like '%millions d''euros%' then 'MEUR'
  when note like '%centime%d''euro%' then 'cEUR' else 'EUR' end as unit from sources cross join range(1900, 2101) y(year)),
m as (select * from (values ('€', 'EUR'), ('eur', 'EUR'), ('euro', 'EUR'), ('euros', 'EUR'), ('c€', 'cEUR'), ('ct', 'cEUR'), ('cts', 'cEUR'), ('centimes', 'cEUR'),
  ('k€', 'kEUR'), ('keur', 'kEUR'), ('milliers eur', 'kEUR'), ('milliers d''euros', 'kEUR'), ('m€', 'MEUR'), ('meur', 'MEUR'), ('millions eur', 'MEUR'), ('million(s) €', 'MEUR'), ('millions d''euros', 'MEUR'),
  ('f', 'FRF'), ('ff', 'FRF'), ('frf', 'FRF'), ('francs', 'FRF'), ('kf', 'kFRF'), ('kfrf', 'kFRF'), ('milliers de francs', 'kFRF'), ('mf', 'MFRF'), ('mfrf', 'MFRF'), ('millions de francs', 'MFRF'),
  ('af', 'AF'), ('anciens francs', 'AF')) t(s, unit)),
a as (select 'payout_reports' as src_table, rec_id as row_id, rang, v, coalesce(m1.unit, m2.unit, nt.unit, 'EUR') as unit
  from n left join m m1 on m1.s = lower(w) left join m m2 on m2.s = lower(devise) left join nt on nt.source_code = n.source_code and nt.year = n.year),
b as (select 'tirages' as src_table, id as row_id, rang, v, coalesce(m.unit, 'EUR') as unit from (
  select id, 1 as rang, rapport_rang1::varchar::decimal(24, 6) as v, devise from tirages where rapport_rang1 >= 0 union all select id, 2, rapport_rang2::varchar::decimal(24, 6), devise from tirages where rapport_rang2 >= 0)
  left join m on m.s = lower(trim(devise))),
k as (select * from (values ('cEUR', 1::hugeint, 1::hugeint), ('EUR', 100, 1), ('kEUR', 100000, 1), ('MEUR', 100000000, 1), ('AF', 100000, 655957), ('FRF', 10000000, 655957), ('kFRF', 10000000000, 655957), ('MFRF', 10000000000000, 655957)) t(unit, num, den)),
fig as (select src_table, row_id, rang, v, unit, ((2 * (v * 1000000)::hugeint * num + den * 1000000) // (2 * den * 1000000))::bigint as cents from (select * from a union all select * from b) join k using (unit))"""
ORACLE["p3_found"] = f"{_FIGURES} select src_table, row_id, rang, cents from fig where v > 0 and unit <> 'EUR'"
ORACLE["p3_converted"] = f"{_FIGURES} select src_table, row_id, rang, unit, cents from fig"

ORACLE["p5_found"] = """
with t as (select load_no, boule_1, numero_chance, date_tirage, rapport_rang1,
  case when regexp_full_match(date_tirage, '[0-9]{2}/[0-9]{2}/[0-9]{4}') then try_strptime(date_tirage, '%d/%m/%Y')::date end as day from tirages),
l as (
  select load_no, 'boule_1' as f, boule_1::varchar as v, boule_1 not between 1 and 49 as outside, false as bad,
    case when boule_1 not between 1 and 49 then 'other' else least((boule_1 - 1) // 10, 4)::varchar end as class from t
  union all select load_no, 'numero_chance', numero_chance::varchar, numero_chance not between 1 and 10, false, numero_chance::varchar from t
  union all select load_no, 'date_tirage', nullif(trim(date_tirage), ''), coalesce(day not between date '1976-01-01' and date '2025-12-31', false), day is null, dayname(day) from t
  union all select load_no, 'rapport_rang1', rapport_rang1::varchar, rapport_rang1 not between 0 and 500000000, false,
    case when rapport_rang1 not between 0 and 500000000 then 'other' when rapport_rang1 = 0 then '0' when rapport_rang1 < 3000000 then '3' when rapport_rang1 < 8000000 then '8' else '500' end from t),
p as (select load_no, f, count(*) as n, count(*) - count(v) as nulls, count(v) as m, count(distinct v) as dis,
  count(*) filter (v is not null and bad) as bad, count(*) filter (v is not null and outside) as outs from l group by 1, 2),
ord as (select load_no, lag(load_no) over (order by load_no) as before from (select distinct load_no from tirages)),
c as (select load_no, f, class, count(*) as k from l where v is not null and class is not null group by 1, 2, 3),
s as (select c.load_no, c.f, class, k / m as sh from c join p using (load_no, f)),
sh as (select o.load_no, coalesce(x.f, y.f) as f, max(abs(coalesce(x.sh, 0) - coalesce(y.sh, 0))) as moved
  from ord o join (select distinct load_no, f, class from s union select o2.load_no, f, class from s join ord o2 on o2.before = s.load_no) u on u.load_no = o.load_no
  left join s x on x.load_no = o.load_no and x.f = u.f and x.class = u.class left join s y on y.load_no = o.before and y.f = u.f and y.class = u.class
  where o.before is not null group by 1, 2),
j as (select p.*, q.dis as dis0, q.m as m0, moved from p join ord using (load_no) left join p q on q.load_no = ord.before and q.f = p.f left join sh on sh.load_no = p.load_no and sh.f = p.f)
select load_no, f as field_name, 'null_rate' as issue from j where nulls >= 0.05 * n
union all select load_no, f, 'pattern' from j where bad > 0 and bad >= 0.01 * m
union all select load_no, f, 'range' from j where outs > 0 and outs >= 0.01 * m
union all select load_no, f, 'distinct' from j where f <> 'date_tirage' and dis < dis0 / 2
union all select load_no, f, 'shift' from j where m > 0 and m0 > 0 and round(moved, 6) >= 0.2"""


def _profiled(column: str, kind: str) -> str:
    """A column of tirages in SQL: load_no, f, v (as text, null where blank), num, class, bad, outside."""
    v, num, bad, outside = f"{column}::varchar", f"{column}::double", "false", "false"
    if kind == "string":
        v, num = f"case when trim({column}, ' \u00a0') <> '' then {column} end", f"try_cast({column} as double)"
    if kind == "timestamp":
        num = f"epoch_us({column}) / 1000000"
    shape = f"regexp_replace(regexp_replace(regexp_replace({v}, '[0-9]+', '9', 'g'), '\\p{{L}}+', 'a', 'g'), '\\s+', ' ', 'g')"
    power = f"floor(log10(abs({num})))::bigint::varchar"
    kind_of = f"case when {num} = 0 then '0' when {num} < 0 then '-e' || {power} when {num} > 0 then 'e' || {power} else {shape} end"
    if kind == "timestamp":
        kind_of = shape
    if column == "boule_1":
        outside = "boule_1 not between 1 and 49"
        kind_of = "case when boule_1 not between 1 and 49 then 'other' else least((boule_1 - 1) // 10, 4)::varchar end"
    if column == "numero_chance":
        outside, kind_of = "numero_chance not between 1 and 10", "numero_chance::varchar"
    if column == "rapport_rang1":
        outside = "rapport_rang1 not between 0 and 500000000"
        kind_of = "case when rapport_rang1 not between 0 and 500000000 then 'other' when rapport_rang1 = 0 then '0' when rapport_rang1 < 3000000 then '3' when rapport_rang1 < 8000000 then '8' else '500' end"
    if column == "date_tirage":
        num, bad, outside = "(day - date '1970-01-01')::double", "day is null", "coalesce(day not between date '1976-01-01' and date '2025-12-31', false)"
        kind_of = "dayname(day)"
    return f"select load_no, '{column}' as f, {v} as v, {num} as num, {kind_of} as class, {bad} as bad, {outside} as outside from t"


_COLUMNS = [("id", "bigint"), ("loaded_at", "timestamp"), *LAYOUT.values()]
ORACLE["p5_profile"] = f"""
with t as (select *, case when regexp_full_match(date_tirage, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_strptime(date_tirage, '%d/%m/%Y')::date end as day from tirages),
l as ({" union all ".join(_profiled(c, k) for c, k in _COLUMNS)}),
p as (select load_no, f, count(*) as rows, count(*) - count(v) as nulls, count(v) as m, count(distinct v) as dis, min(num) filter (v is not null) as low, max(num) filter (v is not null) as high,
  count(*) filter (v is not null and bad) as bad, count(*) filter (v is not null and outside) as outs from l group by 1, 2),
ord as (select load_no, lag(load_no) over (order by load_no) as before from (select distinct load_no from tirages)),
c as (select load_no, f, class, count(*) as k from l where v is not null and class is not null group by 1, 2, 3),
z as (select load_no, f, class, sum(a) as a, sum(b) as b from (select c.load_no, f, class, k as a, 0 as b from c join ord using (load_no) where before is not null
  union all select ord.load_no, f, class, 0, k from c join ord on ord.before = c.load_no) group by 1, 2, 3),
w as (select z.*, x.m as na, y.m as nb, a / x.m as p, b / y.m as q, greatest(a / x.m, cast(0.5 as double) / x.m) as pp, greatest(b / y.m, cast(0.5 as double) / y.m) as qq
  from z join ord using (load_no) join p x on x.load_no = z.load_no and x.f = z.f join p y on y.load_no = ord.before and y.f = z.f where x.m > 0 and y.m > 0),
g as (select load_no, f, round(max(abs(p - q)), 6) as moved, round(sum((pp - qq) * ln(pp / qq)), 6) as psi, round(sum(pow(sqrt(nb / na) * a - sqrt(na / nb) * b, 2) / (a + b)), 6) as chi2 from w group by 1, 2)
select p.load_no, p.f as field_name, p.rows, p.nulls, p.dis as n_distinct, y.dis as distinct_before, p.low, p.high, p.bad, p.outs as outside, moved, psi, chi2
from p join ord using (load_no) left join p y on y.load_no = ord.before and y.f = p.f left join g on g.load_no = p.load_no and g.f = p.f"""
