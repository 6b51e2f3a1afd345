"""Registered queries of the draw operators, over `draws` and `tirages`, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, combos, frequency, markov, periodicity, prizes, quality, stats, strategies
from ..operators.views import first_valid, occurrences, ordered_draws
from ..schema import BALLS, LAYOUT
from ..sources import draw_files
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_BALLS = ", ".join(BALLS)
_VALID = " and ".join(f"{b} between 1 and 49" for b in BALLS)
#: Clean draws in SQL: f (per key the first valid row), d (in the observed order), occ (long form), nn (their number).
_DRAWS = f"""
with v as (select *, trim(annee_numero) as k from draws
           where trim(annee_numero) <> '' and numero_chance between 1 and 10 and {_VALID}),
f as (select * from v qualify row_number() over (partition by k order by draw_idx) = 1),
d as (select row_number() over (order by coalesce(date_tirage, ''), k) - 1 as di, k, draw_date, date_tirage,
             trim(jour_tirage) as jour, {_BALLS}, numero_chance as chance, combinaison_croissante from f),
occ as ({" union all ".join(f"select di, {i + 1} as pos, {b} as ball from d" for i, b in enumerate(BALLS))}),
nn as (select count(*) as n from d)"""


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, prefix: str = _DRAWS) -> None:
    QUERIES[name] = query
    if sql is not None:
        joint = ", " if sql.lstrip().startswith("+") else " "
        ORACLE[name] = prefix + joint + sql.lstrip().lstrip("+") if prefix else sql


def _first(s: SparkSession, r: str) -> DataFrame:
    return first_valid(table(s, r, "draws"))


def _ordered(s: SparkSession, r: str) -> DataFrame:
    return ordered_draws(table(s, r, "draws"))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# sources
_add(
    "draw_scan",
    lambda s, r: _ordered(s, r).select("di", "annee_numero", "date_tirage", "jour_tirage", *BALLS, "numero_chance", "combinaison_croissante"),
    f"select di, k as annee_numero, date_tirage, jour as jour_tirage, {_BALLS}, chance as numero_chance, combinaison_croissante from d",
)
_add(
    "draw_scan_by_date",
    lambda s, r: ordered_draws(table(s, r, "draws"), "date").select("di", "annee_numero", "draw_date"),
    "select row_number() over (order by draw_date asc nulls first, k) - 1 as di, k as annee_numero, draw_date from d",
)
_add(
    "load_counters",
    lambda s, r: table(s, r, "draws")
    .agg(F.count("*").alias("read"))
    .join(F.broadcast(_first(s, r).agg(F.count("*").alias("inserted"))))
    .select("read", "inserted", (F.col("read") - F.col("inserted")).alias("skipped")),
    "select (select count(*) from draws) as read, n as inserted, (select count(*) from draws) - n as skipped from nn",
)
_add("occurrences", lambda s, r: occurrences(_ordered(s, r), "di"), "select di, pos, ball from occ")

# frequencies
_add("freq_overall", lambda s, r: frequency.overall(_first(s, r)), "select ball, count(*) as cnt from occ group by ball")
_add("freq_by_position", lambda s, r: frequency.by_position(_first(s, r)), "select pos, ball, count(*) as cnt from occ group by pos, ball")
_add(
    "recency_top10",
    lambda s, r: frequency.recency(_ordered(s, r)),
    """+ u as (select distinct ball, di from occ),
    k as (select ball, di, row_number() over (partition by ball order by di desc) as nth from u qualify nth <= 10)
    select b.ball::int as ball, coalesce(nth, 1)::int as nth, coalesce(n - di, n) as age
    from range(1, 50) b(ball) left join k on k.ball = b.ball cross join nn""",
)
_SEEN = "+ s as (select ball, count(*) as cnt, min(di * 5 + pos) as fst from occ group by ball)"
_HOT = "select row_number() over (order by cnt desc, fst)::int as rank, ball, cnt from s where cnt > {e} * cast(1.1 as double) qualify rank <= 10"
_COLD = "select row_number() over (order by cnt, fst)::int as rank, ball, cnt from s where cnt < {e} * cast(0.9 as double) qualify rank <= 10"
_OBSERVED, _INTENDED = "(select count(*) / cast(49 as double) from s)", "(select sum(cnt) / cast(49 as double) from s)"
_add("hot_numbers", lambda s, r: frequency.hot_cold(_ordered(s, r))[0], f"{_SEEN} {_HOT.format(e=_OBSERVED)}")
_add("cold_numbers", lambda s, r: frequency.hot_cold(_ordered(s, r))[1], f"{_SEEN} {_COLD.format(e=_OBSERVED)}")
_add("hot_numbers_intended", lambda s, r: frequency.hot_cold(_ordered(s, r), "intended")[0], f"{_SEEN} {_HOT.format(e=_INTENDED)}")
_add("cold_numbers_intended", lambda s, r: frequency.hot_cold(_ordered(s, r), "intended")[1], f"{_SEEN} {_COLD.format(e=_INTENDED)}")
_add(
    "hot_cold_by_position",
    lambda s, r: frequency.hot_cold_by_position(_ordered(s, r)),
    """+ s as (select pos, ball, count(*) as cnt, min(di) as fst from occ group by pos, ball),
    q as (select *, row_number() over (partition by pos order by cnt desc, fst)::int as rank, count(*) over (partition by pos) as m from s)
    select pos, 'hot' as side, rank, ball, cnt from q where rank <= 3
    union all select pos, 'cold', rank, ball, cnt from q where rank > m - 3""",
)
_add("chance_overall", lambda s, r: frequency.chance_overall(_first(s, r)), "select chance, count(*) as cnt from d group by chance")
_add("chance_by_day", lambda s, r: frequency.chance_by_day(_first(s, r)), "select jour, chance, count(*) as cnt from d group by jour, chance")
_add("draws_by_day", lambda s, r: frequency.draws_by_day(_first(s, r)), "select jour, count(*) as cnt from d where jour is not null group by jour")
_GAPS = """+ o as (select ball, di, di - lag(di) over (partition by ball order by di) as gap from occ)
    select ball, {what} from o cross join nn group by ball, n having count(*) >= 2"""
_add("gap_avg", lambda s, r: _rounded(frequency.gaps(_ordered(s, r)).select("ball", "avg_gap"), "avg_gap"), _GAPS.format(what="round(avg(gap), 6) as avg_gap"))
_add("gap_current", lambda s, r: frequency.gaps(_ordered(s, r)).select("ball", "absence"), _GAPS.format(what="n - max(di) as absence"))

# pairs and triplets
_PAIRS = """+ pc as (select least(x.ball, y.ball) as a, greatest(x.ball, y.ball) as b, count(*) as cnt
    from occ x join occ y on x.di = y.di and x.pos < y.pos group by 1, 2)"""
_add("pair_counts", lambda s, r: combos.pair_counts(_first(s, r)), f"{_PAIRS} select a, b, cnt from pc")
_add(
    "pair_matrix",
    lambda s, r: combos.pair_matrix(_first(s, r)),
    f"{_PAIRS}, m as (select a, b, cnt from pc union all select b, a, cnt from pc where a <> b) select r.ball::int as ball, "
    + ", ".join(f"coalesce(sum(cnt) filter (b = {i}), 0)::bigint as c{i}" for i in range(1, 50))
    + " from range(1, 50) r(ball) left join m on m.a = r.ball group by r.ball",
)
_add(
    "triplet_top",
    lambda s, r: combos.triplets(_ordered(s, r)),
    """+ so as (select di, ball, row_number() over (partition by di order by ball, pos) - 1 as i from occ),
    t as (select x.ball as a, y.ball as b, z.ball as c, count(*) as cnt, min(x.di * 1000 + x.i * 100 + y.i * 10 + z.i) as fst
          from so x join so y on x.di = y.di and x.i < y.i join so z on y.di = z.di and y.i < z.i group by 1, 2, 3)
    select row_number() over (order by cnt desc, fst)::int as rank, a, b, c, cnt from t qualify rank <= 30""",
)
_CHI = """, q as (select a, b, cnt, n, n * cast({rate!r} as double) as e from p cross join nn),
    c as (select *, greatest(cast(0 as double), abs(cnt - e) / 2 - cast(0.5 as double)) as h from q),
    z as (select *, h * h * (4 / (cnt + e) + 4 / (2 * n - (cnt + e))) as x from c),
    t as (select *, 1 / (1 + sqrt(x / 2) / 2) as t from z)
    select a, b, cnt, round(e, 6) as expected, round(x, 6) as chi2, round(t * exp(-x / 2 + {fit}), 6) as p_value, x > 3.841458820694124::double as p05, x > 6.634896601021214::double as p01 from t"""
_FIT = "".join(f"{c!r}::double + t * (" for c in combos.ERFC_FIT[:-1]) + f"{combos.ERFC_FIT[-1]!r}::double" + ")" * (len(combos.ERFC_FIT) - 1)
_add(
    "pair_chi2",
    lambda s, r: _rounded(combos.pair_significance(_first(s, r)), "expected", "chi2", "p_value"),
    f"{_PAIRS}, p as (select a, b + 1 as b, cnt from pc where b + 1 <= 49 order by cnt desc, a, b limit 50)" + _CHI.format(rate=(5 / 49) ** 2 * 2, fit=_FIT),
)
_add(
    "pair_chi2_intended",
    lambda s, r: _rounded(combos.pair_significance(_first(s, r), "intended"), "expected", "chi2", "p_value"),
    f"{_PAIRS}, p as (select a, b, cnt from pc where a < b order by cnt desc, a, b limit 50)" + _CHI.format(rate=20 / (49 * 48), fit=_FIT),
)

# distributions
_SUM = "+ m as (select *, boule_1 + boule_2 + boule_3 + boule_4 + boule_5 as s, " + " + ".join(f"(({b} % 2) = 0)::int" for b in BALLS) + " as ev from d)"
_add(
    "dist_sum",
    lambda s, r: _rounded(stats.sum_distribution(_first(s, r)), "mean", "std"),
    f"{_SUM} select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, min(s) as min, max(s) as max, median(s)::double as median from m",
)
_add(
    "dist_decades",
    lambda s, r: _rounded(stats.decade_distribution(_first(s, r)), "mean", "std"),
    "+ g as (select di, t, count(*) filter (least((ball - 1) // 10, 4) = t) as x from occ cross join range(5) r(t) group by di, t)"
    "select ['1-10', '11-20', '21-30', '31-40', '41-49'][t + 1] as decade, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std from g group by t",
)
_add(
    "dist_parity",
    lambda s, r: _rounded(stats.parity_distribution(_first(s, r)), "mean_ratio", "std_ratio"),
    f"{_SUM} select round(avg(ev / 5), 6) as mean_ratio, round(stddev_pop(ev / 5), 6) as std_ratio from m",
)
_add(
    "draw_features",
    lambda s, r: _rounded(stats.features(_ordered(s, r), "di"), "even_ratio", "std", "mean", "low_fraction", "mid_fraction"),
    """select di, sum(ball)::int as sum, round(avg((ball % 2 = 0)::int), 6) as even_ratio, min(ball) as min, max(ball) as max,
    round(stddev_pop(ball), 6) as std, round(avg(ball), 6) as mean, max(ball) - min(ball) as range,
    round(avg((ball <= 10)::int), 6) as low_fraction, round(avg((ball between 21 and 30)::int), 6) as mid_fraction from occ group by di""",
)
_add(
    "anomaly_baseline",
    lambda s, r: _rounded(stats.baseline(_first(s, r)), "sum_mean", "sum_std", "even_mean", "even_std"),
    f"{_SUM} select round(avg(s), 6) as sum_mean, round(stddev_pop(s), 6) as sum_std, round(avg(ev / 5), 6) as even_mean, round(stddev_pop(ev / 5), 6) as even_std from m",
)
_add(
    "anomalies",
    lambda s, r: _rounded(stats.anomalies(_first(s, r)), "sum_z", "even_ratio", "even_z"),
    f"""{_SUM}, b as (select avg(s) as sm, stddev_pop(s) as ss, avg(ev / 5) as em, stddev_pop(ev / 5) as es from m)
    select k as annee_numero, date_tirage, s as sum, round(abs(s - sm) / ss, 6) as sum_z, round(ev / 5, 6) as even_ratio,
    round(abs(ev / 5 - em) / greatest(es, 1e-9), 6) as even_z from m cross join b
    where abs(s - sm) / ss > 2.5 or abs(ev / 5 - em) / greatest(es, 1e-9) > 2.5""",
)
_add(
    "spearman_positions",
    lambda s, r: _rounded(stats.spearman_positions(_first(s, r)), "rho"),
    """+ rk as (select di, pos, rank() over (partition by pos order by ball) + (count(*) over (partition by pos, ball) - 1) / 2 as r from occ)
    select x.pos as i, y.pos as j, round(corr(x.r, y.r), 6) as rho from rk x join rk y on x.di = y.di and x.pos <= y.pos group by 1, 2 having count(*) >= 10""",
)

# transitions
_MARKOV = """+ t as (select x.ball as from_ball, y.ball as to_ball, count(*) as cnt from occ x join occ y on y.di = x.di + 1 group by 1, 2),
    mk as (select from_ball, to_ball, t.cnt, t.cnt / g.m as prob from t join (select ball, count(*) as m from occ group by ball) g on g.ball = from_ball)"""
_add(
    "markov_transitions",
    lambda s, r: _rounded(markov.transitions(_ordered(s, r)), "prob"),
    f"{_MARKOV} select from_ball, to_ball, cnt, round(prob, 6) as prob from mk",
)
_add(
    "markov_predict",
    lambda s, r: _rounded(markov.predict_next(_ordered(s, r)), "score"),
    f"""{_MARKOV}, l as (select distinct ball from occ where di = (select max(di) from d)),
    sc as (select r.ball::int as ball, coalesce(sum(prob), 0) as sc from range(1, 50) r(ball)
           left join (select * from mk where from_ball in (select ball from l)) m on m.to_ball = r.ball
           where r.ball not in (select ball from l) group by 1)
    select row_number() over (order by sc desc, ball desc)::int as rank, ball, round(sc / sum(sc) over (), 6) as score from sc qualify rank <= 10""",
)
_add(
    "markov_lookup",
    lambda s, r: _rounded(markov.lookup(markov.transitions(_ordered(s, r)), 7, 12), "prob"),
    f"{_MARKOV} select 7 as from_ball, 12 as to_ball, round(coalesce(max(prob), 0), 6) as prob from mk where from_ball = 7 and to_ball = 12",
)

# clusters
_add("cluster_assign", lambda s, r: clusters.assign(_ordered(s, r), 5, "di").select("di", "cluster"))
_add("cluster_profiles", lambda s, r: clusters.profiles(clusters.assign(_ordered(s, r), 5, "di")))

# periodicity
_add(
    "binary_series",
    lambda s, r: periodicity.binary_series(_ordered(s, r)),
    "select r.ball::int as ball, n, count(distinct di) as hits from range(1, 50) r(ball) left join occ on occ.ball = r.ball cross join nn group by r.ball, n",
)
_add(
    "ball_series",
    lambda s, r: periodicity.ball_series(_ordered(s, r)),
    "+ h as (select distinct ball, di from occ) select r.ball::int as ball, dd.di, (h.di is not null)::int as hit from range(1, 50) r(ball) cross join (select di from d) dd left join h on h.ball = r.ball and h.di = dd.di",
)
#: ac(ball, lag, r): autocorrelation of every ball's series.
_ACF = """+ h as (select distinct ball, di from occ),
    g as (select r.ball::int as ball, di, (h.di is not null)::int as x from range(1, 50) r(ball) cross join (select di from d) dd left join h using (ball, di)),
    m as (select ball, avg(x) as mu, var_pop(x) as va from g group by ball),
    hp as (select a.ball, b.di - a.di as lag, count(*) as c from h a join h b on a.ball = b.ball and b.di - a.di between 1 and 49 group by 1, 2),
    l as (select r.lag::int as lag from range(50) r(lag) cross join nn where r.lag < least(n // 2, 50)),
    e as (select ball, lag, sum(x) filter (di < n - lag) as hd, sum(x) filter (di >= lag) as tl from g cross join l cross join nn
          where di < 50 or di >= n - 50 group by 1, 2),
    w as (select ball, sum(x) filter (di >= 50 and di < n - 50) as mid from g cross join nn group by 1),
    ac as (select m.ball, l.lag, case when va < 1e-12 then 0 when l.lag = 0 then 1 else
      (coalesce(c, 0) - mu * (coalesce(hd, 0) + coalesce(tl, 0) + 2 * coalesce(mid, 0)) + (n - l.lag) * mu * mu) / (n - l.lag) / va end as r
    from m cross join l cross join nn left join hp on hp.ball = m.ball and hp.lag = l.lag
    join e on e.ball = m.ball and e.lag = l.lag join w on w.ball = m.ball)"""
_add("acf", lambda s, r: _rounded(periodicity.acf(_ordered(s, r)), "r"), f"{_ACF} select ball, lag, round(r, 6) as r from ac")
#: pk(ball, k, period, magnitude, rank): peaks of the Fourier transform, summed hit by hit.
_DFT = """hh as (select distinct ball, di from occ),
    ft as (select ball, k.k as k, sqrt(pow(sum(cos(2 * pi() * (k.k * di % n) / n)), 2) + pow(sum(sin(2 * pi() * (k.k * di % n) / n)), 2)) as mag
           from hh cross join nn cross join range(1, (select n // 2 + 1 from nn)) k(k) where n >= 10 group by 1, 2),
    th as (select ball, avg(mag) + 2 * stddev_pop(mag) as least from ft group by ball),
    pk as (select ball, k, round_even(n / k, 0)::bigint as period, mag as magnitude, row_number() over (partition by ball order by round(mag, 9) desc, k) as rank
           from ft join th using (ball) cross join nn where mag > least and k >= 2 and n >= 5 * k qualify rank <= 5)"""
_add(
    "dft_periods",
    lambda s, r: _rounded(periodicity.dft_peaks(_ordered(s, r)), "magnitude"),
    f"+ {_DFT} select ball, k, period, round(magnitude, 6) as magnitude, rank from pk",
)
_add(
    "periodicity_summary",
    lambda s, r: _rounded(periodicity.summary(_ordered(s, r)), "rate"),
    f"""{_ACF}, {_DFT}, sl as (select ball, lag from ac cross join nn where lag >= 1 and abs(r) > cast(1.96 as double) / sqrt(n)),
    nl as (select ball, count(*) as n_lags, array_to_string(list_sort(list(lag))[1:10], ',') as lags from sl group by ball),
    np as (select ball, count(*) as n_periods, array_to_string(list(period order by rank)[1:3], ',') as periods from pk group by ball),
    al as (select m.ball, round(mu, 6) as rate, coalesce(n_lags, 0) as n_lags, coalesce(n_periods, 0) as n_periods, coalesce(lags, '') as lags, coalesce(periods, '') as periods
           from m cross join nn left join nl using (ball) left join np using (ball) where n >= 20)
    select *, n_lags > 0 and n_periods > 0 as cyclic, case when n_lags > 0 and n_periods > 0 then
      row_number() over (partition by n_lags > 0 and n_periods > 0 order by least(n_lags, 5) + least(n_periods, 5) desc, ball)::int end as rank from al""",
)

# strategies
_P = 2147483647
_HITS = "h as (select distinct ball, di from occ), g as (select r.ball::int as ball, di, coalesce(c, 0) as hit, ord from range(1, 50) r(ball) cross join (select di from d) dd left join (select ball, di, count(*) as c, min(di * 5 + pos) as ord from occ group by 1, 2) o using (ball, di))"


def _uniform(source: str, out: str, di: str = "di", item: str = "ball") -> str:
    """CTEs that add u to `source`(di, item, seed), as functions.rand does."""
    five = lambda a, b, x: (
        f"{a} as (select *, {x}::bigint * {x} % {_P} as q from {b}), {a}b as (select * exclude q, q * q % {_P} * {x} % {_P} as y from {a})"
    )
    start = f"{out}0 as (select *, ({di}::bigint * 1000003 + {item}::bigint * 9176 + seed) % {_P - 1} + 1 as x from {source})"
    again = f"{out}2 as (select * exclude (x, y), (y * 48271 + {item}::bigint * 7919 + 1) % {_P - 1} + 1 as x from {out}1b)"
    last = f"{out} as (select * exclude (x, y), y as raw, y / cast({_P} as double) as u from {out}3b)"
    return ", ".join([start, five(f"{out}1", f"{out}0", "x"), again, five(f"{out}3", f"{out}2", "x"), last])


def _pivot(source: str) -> str:
    """Tickets (di, strategy, ticket, ball) as b1..b5 with the number of balls that were drawn."""
    return f"""tk as (select strategy, di, ticket, list_sort(list(ball)) as bs from {source} group by 1, 2, 3),
    one as (select * from tk qualify row_number() over (partition by strategy, di, bs order by ticket) = 1),
    fin as (select strategy, one.di, ticket, bs, len(list_intersect(bs, [{_BALLS}])) as matches from one join d on d.di = one.di)"""


_HOT_T = """hw as (select di, ball, sum(hit) over w as c, min(ord) over w as fst from g
    window w as (partition by ball order by di rows between 100 preceding and 1 preceding)),
    hot as (select 'hot' as strategy, di, 1 as ticket, ball from hw where di >= 20
    qualify row_number() over (partition by di order by coalesce(c, 0) desc, fst, ball) <= 5)"""
_W200 = "cw as (select di, ball, coalesce(sum(hit) over (partition by ball order by di rows between 200 preceding and 1 preceding), 0) as c from g)"


def _weighted(configs: list[tuple[str, int, int, float]]) -> str:
    """CTE wt(strategy, di, ticket, ball) for (name, seed, tickets, bias)."""
    rows = ", ".join(f"('{n}', {s * 1000 + k}, {k}, {b}::double)" for n, s, m, b in configs for k in range(1, m + 1))
    return f"""cfg as (select * from (values {rows}) t(strategy, seed, ticket, bias)),
    wi as (select di, ball, c, strategy, seed, ticket, bias from cw cross join cfg where di >= 20), {_uniform("wi", "wu")},
    wt as (select strategy, di, ticket, ball from wu
    qualify row_number() over (partition by strategy, di, ticket order by -ln(u) * pow(c + 1, bias), ball) <= 5)"""


_PAIRED = f"""so as (select di, ball, row_number() over (partition by di order by ball, pos) - 1 as i from occ),
    pr as (select x.di, x.ball as a, y.ball as b, x.di * 100 + x.i * 10 + y.i as ord from so x join so y on x.di = y.di and x.i < y.i),
    pw as (select t.di, a, b, count(*) as c, min(ord) as fst from (select di from d where di >= 20) t join pr on pr.di between t.di - 200 and t.di - 1 group by 1, 2, 3),
    pk as (select *, row_number() over (partition by di order by c desc, fst) as rk from pw qualify rk <= 30),
    pb as (select di, ball, sum(c) as w, min(o) as o from (select di, a as ball, c, rk * 2 as o from pk union all select di, b, c, rk * 2 + 1 from pk) group by 1, 2),
    pp as (select di, ball from pb qualify row_number() over (partition by di order by w desc, o) <= 10),
    ps as (select pp.*, seed, ticket from pp cross join (values (2001, 1), (2002, 2), (2003, 3)) s(seed, ticket)), {_uniform("ps", "pu")},
    pt as (select 'paired' as strategy, di, ticket, ball from pu where di in (select di from pp group by di having count(*) >= 5)
    qualify row_number() over (partition by di, ticket order by u, ball) <= 5)"""
_COLS = "select di, ticket::int as ticket, bs[1] as b1, bs[2] as b2, bs[3] as b3, bs[4] as b4, bs[5] as b5, matches::int as matches"
_BY = {s.name: s for s in strategies.STRATEGIES}


def _tickets(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    cols = ["di", "ticket", "b1", "b2", "b3", "b4", "b5", "matches"]
    cols = cols if len(names) == 1 else ["strategy", *cols]
    return lambda s, r: strategies.tickets(_ordered(s, r), [_BY[n] for n in names]).select(*cols)


_COLD_C, _WEIGHTED_C = [("cold", 1, 1, 1.0)], [("weighted_1.5", 3, 3, 1.5), ("weighted_3.0", 4, 3, 3.0)]
_add("strategy_hot_tickets", _tickets("hot"), f"+ {_HITS}, {_HOT_T}, {_pivot('hot')} {_COLS} from fin")
_add("strategy_cold_tickets", _tickets("cold"), f"+ {_HITS}, {_W200}, {_weighted(_COLD_C)}, {_pivot('wt')} {_COLS} from fin")
_add("strategy_paired_tickets", _tickets("paired"), f"+ {_PAIRED}, {_pivot('pt')} {_COLS} from fin")
_add(
    "strategy_weighted_tickets",
    _tickets("weighted_1.5", "weighted_3.0"),
    f"+ {_HITS}, {_W200}, {_weighted(_WEIGHTED_C)}, {_pivot('wt')} {_COLS.replace('select', 'select strategy,', 1)} from fin",
)
_RESULT = """, won as (select strategy, di, count(*) * cast(2 as double) as cost,
    sum(case when matches = 5 then 1000000 when matches >= 4 then 150 else 0 end)::bigint as won from fin group by 1, 2)"""
_BACK = (
    _RESULT
    + """ select strategy, sum(cost) as invested, sum(won)::bigint as won, sum(won)::bigint - sum(cost) as net,
    round((sum(won)::bigint - sum(cost)) / sum(cost) * 100, 6) as roi_pct, max(won) as max_win, count(*) filter (won > 0) as winning_draws,
    any_value(n) - 20 as draws_evaluated from won cross join nn group by strategy"""
)


def _backtest(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, r: _rounded(strategies.backtest(_ordered(s, r), [_BY[n] for n in names]), "roi_pct")


_add("backtest_hot", _backtest("hot"), f"+ {_HITS}, {_HOT_T}, {_pivot('hot')}{_BACK}")
_add("backtest_cold", _backtest("cold"), f"+ {_HITS}, {_W200}, {_weighted(_COLD_C)}, {_pivot('wt')}{_BACK}")
_add("backtest_paired", _backtest("paired"), f"+ {_PAIRED}, {_pivot('pt')}{_BACK}")
_add("backtest_weighted", _backtest("weighted_1.5", "weighted_3.0"), f"+ {_HITS}, {_W200}, {_weighted(_WEIGHTED_C)}, {_pivot('wt')}{_BACK}")
_add(
    "backtest_all",
    _backtest(*_BY),
    f"+ {_HITS}, {_HOT_T}, {_W200}, {_weighted(_COLD_C + _WEIGHTED_C)}, {_PAIRED}, "
    f"al as (select * from hot union all select * from wt union all select * from pt), {_pivot('al')}{_BACK}",
)
_add(
    "backtest_balance",
    lambda s, r: strategies.balance(strategies.per_draw(strategies.tickets(_ordered(s, r), [_BY["hot"]]))),
    f"+ {_HITS}, {_HOT_T}, {_pivot('hot')}{_RESULT} select strategy, di, sum(won - cost) over (partition by strategy order by di) as balance from won",
)

_add(
    "backtest_winning_dates",
    lambda s, r: (lambda d: strategies.winning_dates(d, strategies.per_draw(strategies.tickets(d, list(_BY.values())))))(_ordered(s, r)),
    f"+ {_HITS}, {_HOT_T}, {_W200}, {_weighted(_COLD_C + _WEIGHTED_C)}, {_PAIRED}, "
    f"al as (select * from hot union all select * from wt union all select * from pt), {_pivot('al')}{_RESULT}"
    " select strategy, row_number() over (partition by strategy order by won.di)::int as nth, won.di, date_tirage, won from won join d on d.di = won.di where won > 0 qualify nth <= 10",
)

# chance numbers
_CH = "ch as (select c.chance::int as chance, dd.di, (dd.chance = c.chance)::int as hit, jour from range(1, 11) c(chance) cross join d dd)"


def _chance_two(method: str, seed: int) -> str:
    if method == "frequency":
        weights = "cwt as (select di, chance, coalesce(sum(hit) over (partition by chance order by di rows between 200 preceding and 1 preceding), 0) + 1 as w from ch)"
    elif method == "recent":
        weights = "cwt as (select di, chance, coalesce(sum(hit) over (partition by chance order by di rows between 10 preceding and 1 preceding), 0) + cast(0.5 as double) as w from ch)"
    else:
        weights = """dy as (select t.di, x.jour, x.chance, count(*) as c, min(x.di) as fst from d t join d x on x.di between t.di - 200 and t.di - 1 group by 1, 2, 3),
        dw as (select t.di, x.jour, count(*) as m from d t join d x on x.di between t.di - 200 and t.di - 1 group by 1, 2),
        d3 as (select * from dy qualify row_number() over (partition by di, jour order by c desc, fst) <= 3),
        sc as (select d3.di, chance, sum(c * m) as w from d3 join dw on dw.di = d3.di and dw.jour = d3.jour group by 1, 2),
        cwt as (select ch.di, ch.chance, coalesce(w, 0) as w from ch left join sc on sc.di = ch.di and sc.chance = ch.chance)"""
    return f"""{weights}, ci as (select *, {seed} as seed from cwt), {_uniform("ci", "cu", item="chance")}
    select di, row_number() over (partition by di order by case when w > 0 then -ln(u) / w else 'infinity'::double end, chance)::int as rank, chance
    from cu where di >= 50 qualify rank <= 2"""


def _predicted(method: str, mode: str = "default") -> Callable[[SparkSession, str], DataFrame]:
    import numpy as np
    import pandas as pd

    seed = 50_000 + 100 * strategies.METHODS.index(method) + 51

    def kernel(t) -> pd.DataFrame:
        keep = np.flatnonzero(t.di[t.own] >= strategies.CHANCE_WARM_UP)
        two = strategies.chance_order(t, method, seed, mode)[keep]
        di = t.di[t.own][keep]
        return pd.DataFrame({"di": np.repeat(di, 2), "rank": np.tile([1, 2], len(di)), "chance": two.ravel()})

    from ..operators.views import over_blocks

    return lambda s, r: over_blocks(_ordered(s, r), 200, kernel, "di long, rank int, chance int")


_add("chance_pred_frequency", _predicted("frequency"), f"+ {_CH}, {_chance_two('frequency', 50_051)}")
_add("chance_pred_day", _predicted("day_conditional"), f"+ {_CH}, {_chance_two('day_conditional', 50_151)}")
_add("chance_pred_recent", _predicted("recent"), "select di, r.rank::int as rank, r.rank::int as chance from d cross join range(1, 3) r(rank) where di >= 50")
_add("chance_pred_recent_intended", _predicted("recent", "intended"), f"+ {_CH}, {_chance_two('recent', 50_251)}")
_CHANCE = f"""+ {_HITS}, {_W200}, {_CH},
    att as (select m.method, m.base, a.a as attempt from (values ('frequency', 50000), ('day_conditional', 50100), ('recent', 50200)) m(method, base) cross join range(1, 10) a(a)),
    mi as (select di, ball, c, method, attempt, base + attempt as seed from cw cross join att where di >= 50), {_uniform("mi", "mu")},
    mt as (select * from mu qualify row_number() over (partition by method, di, attempt order by -ln(u) * (c + 1), ball) <= 5),
    mb as (select method, di, attempt, list_sort(list(ball)) as bs from mt group by 1, 2, 3),
    dy as (select t.di, x.jour, x.chance, count(*) as c, min(x.di) as fst from d t join d x on x.di between t.di - 200 and t.di - 1 group by 1, 2, 3),
    dw as (select t.di, x.jour, count(*) as m from d t join d x on x.di between t.di - 200 and t.di - 1 group by 1, 2),
    d3 as (select * from dy qualify row_number() over (partition by di, jour order by c desc, fst) <= 3),
    sc as (select d3.di, chance, sum(c * m) as w from d3 join dw on dw.di = d3.di and dw.jour = d3.jour group by 1, 2),
    cwt as (select 'frequency' as method, di, chance, coalesce(sum(hit) over (partition by chance order by di rows between 200 preceding and 1 preceding), 0) + 1 as w from ch
      union all select 'day_conditional', ch.di, ch.chance, coalesce(w, 0) from ch left join sc on sc.di = ch.di and sc.chance = ch.chance),
    ci as (select di, chance, w, method, attempt, base + 50 + attempt as seed from cwt join att using (method) where di >= 50), {_uniform("ci", "cu", item="chance")},
    c2 as (select method, di, attempt, row_number() over (partition by method, di, attempt order by case when w > 0 then -ln(u) / w else 'infinity'::double end, chance) as j, chance from cu qualify j <= 2
      union all select method, di, attempt, j.j, j.j from att cross join d cross join range(1, 3) j(j) where method = 'recent' and di >= 50),
    cand as (select * from mb join c2 using (method, di, attempt) qualify row_number() over (partition by method, di, bs, chance order by attempt, j) = 1),
    tk as (select *, row_number() over (partition by method, di order by attempt, j) as ticket from cand qualify ticket <= 3),
    lst as (select method, di, arg_max(bs, ticket) as bs from tk group by 1, 2),
    ri as (select di, k.k as item, 90000 as seed from d cross join range(3) k(k) where di >= 50), {_uniform("ri", "ru", item="item")},
    bt as (select method as strategy, di, ticket, bs, chance from tk union all select method || '/random', di, item + 1, bs, raw % 10 + 1 from lst join ru using (di)),
    cfin as (select strategy, bt.di, ticket, bs, bt.chance, len(list_intersect(bs, [{_BALLS}])) as matches, bt.chance = d.chance as hit from bt join d on d.di = bt.di)"""
_add(
    "chance_tickets",
    lambda s, r: strategies.chance_tickets(_ordered(s, r)).select("di", "strategy", "ticket", "b1", "b2", "b3", "b4", "b5", "chance", "matches", "hit_chance"),
    f"{_CHANCE} select di, strategy, ticket::int as ticket, bs[1] as b1, bs[2] as b2, bs[3] as b3, bs[4] as b4, bs[5] as b5, chance::int as chance, matches::int as matches, hit as hit_chance from cfin",
)
_add(
    "backtest_chance",
    lambda s, r: _rounded(strategies.chance_backtest(_ordered(s, r)), "roi_pct", "random_roi_pct", "improvement", "avg_tickets"),
    f"""{_CHANCE}, dl as (select string_split(strategy, '/')[1] as method, strategy like '%/%' as luck, di, count(*) as n, count(*) * 2::double as cost,
      sum(case when matches = 5 and hit then 5000000 when matches = 5 then 1000000 when matches >= 4 then 150 else 0 end)::bigint as won from cfin group by 1, 2, 3),
    sm as (select method, sum(cost) filter (not luck) as invested, sum(won) filter (not luck)::bigint as won, avg(n) filter (not luck) as avg_tickets,
      sum(cost) filter (luck) as random_invested, sum(won) filter (luck)::bigint as random_won from dl group by method),
    rs as (select *, (won - invested) / invested * 100 as roi, (random_won - random_invested) / random_invested * 100 as rroi from sm)
    select method, invested, won, round(avg_tickets, 6) as avg_tickets, random_invested, random_won, round(roi, 6) as roi_pct, round(rroi, 6) as random_roi_pct, round(roi - rroi, 6) as improvement from rs""",
)
_add(
    "sim_parity",
    lambda s, r: _rounded(stats.parity_against_fair(_first(s, r)), "fair"),
    """+ a as (select di, count(*) filter (ball % 2 = 0) as e from occ group by di),
    c as (select r.e::int as e, (select product(24 - i.i) / product(i.i + 1) from range(r.e) i(i)) as even, (select product(25 - i.i) / product(i.i + 1) from range(5 - r.e) i(i)) as odd from range(6) r(e))
    select e as evens, (select count(*) from a where a.e = c.e) as drawn, round(n * coalesce(even, 1) * coalesce(odd, 1) / 1906884, 6) as fair from c cross join nn""",
)

# prizes
_RANKS = " union all ".join(f"select {k} as rang, gagnants_rang{k} as g, rapport_rang{k} as r from tirages" for k in range(1, 10))


def _prize_sql(mode: str, cols: str) -> str:
    values = prizes.OBSERVED_ODDS if mode == "observed" else prizes.INTENDED_ODDS
    paid = "r" if mode == "observed" else "g * r"
    odds = ", ".join(f"({i + 1}, '{prizes.LABELS[i]}', {p!r}::double)" for i, p in enumerate(values))
    return f"""with o as (select * from (values {odds}) t(rang, label, p)), x as ({_RANKS}),
    y as (select rang, count(*) as draws, count(*) filter (g > 0) as won, count(*) filter (g > 0 and r > 0) as paying,
          sum(g) filter (g > 0 and r > 0) as winners, sum(({paid})::decimal(38, 4)) filter (g > 0 and r > 0) as paid,
          sum(g) filter (g > 0) as won_sum, sum(g) as all_sum from x group by rang),
    z as (select o.rang, label, p, draws, won, paying, floor(winners / p)::bigint as players, paid::double as paid, won_sum, all_sum from o join y using (rang))
    select rang, {cols} from z"""


_ROI = "paying, players, round(paid, 2) as paid, round((paid - players * 2.0::double) * 100 / (players * 2.0::double), 6) as roi_pct"
_ROI_COLS = ["rang", "paying", "players", "paid", "roi_pct"]
for _mode, _tail in (("observed", ""), ("intended", "_intended")):
    _add(
        f"prize_roi{_tail}",
        lambda s, r, m=_mode: prizes.by_rank(table(s, r, "tirages"), m).select(*_ROI_COLS).withColumns({"paid": F.round("paid", 2), "roi_pct": F.round("roi_pct", 6)}),
        _prize_sql(_mode, _ROI),
        prefix="",
    )
    _add(
        f"prize_odds_gap{_tail}",
        lambda s, r, m=_mode: _rounded(prizes.by_rank(table(s, r, "tirages"), m).select("rang", "share", "p", "gap", "gap_pct"), "share", "gap", "gap_pct").withColumn("p", F.round("p", 12)),
        _prize_sql(_mode, "round(won / draws, 6) as share, round(p, 12) as p, round(won / draws - p, 6) as gap, round((won / draws - p) / p * 100, 6) as gap_pct"),
        prefix="",
    )
_add(
    "prize_frequency",
    lambda s, r: _rounded(prizes.by_rank(table(s, r, "tirages")).select("rang", "draws", "won", "share", "mean_won", "mean_all"), "share", "mean_won", "mean_all"),
    _prize_sql("observed", "draws, won, round(won / draws, 6) as share, round(won_sum / won, 6) as mean_won, round(all_sum / draws, 6) as mean_all"),
    prefix="",
)
_add(
    "prize_bundle",
    lambda s, r: _rounded(prizes.by_rank(table(s, r, "tirages")).select("rang", "label", F.col("draws").alias("total_draws"), "won", "roi_pct", "share", "gap_pct"), "roi_pct", "share", "gap_pct"),
    _prize_sql("observed", "label, draws as total_draws, won, round((paid - players * 2.0::double) * 100 / (players * 2.0::double), 6) as roi_pct, round(won / draws, 6) as share, round((won / draws - p) / p * 100, 6) as gap_pct"),
    prefix="",
)

# checks of the loaded rows
_COMBI = "list_transform(list_filter(list_transform(string_split({c}, '-'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::bigint)"


def _unsorted(mode: str) -> str:
    numbers = _COMBI.format(c="combinaison_croissante" if mode == "observed" else "regexp_replace(combinaison_croissante, '[+].*$', '')")
    return f"coalesce(combinaison_croissante <> '' and {numbers} <> list_sort({numbers}), false)"


_add("dq_duplicates", lambda s, r: quality.duplicate_keys(table(s, r, "draws")), "select trim(annee_numero) as annee_numero, count(*) as cnt from draws group by 1 having count(*) > 1", prefix="")
_ZERO = {
    "observed": "coalesce(boule_1 = 0 or boule_5 = 0, false)",
    "intended": "not (" + " and ".join(f"coalesce({b} between 1 and 49, false)" for b in BALLS) + ")",
}
for _mode, _tail in (("observed", ""), ("intended", "_intended")):
    _add(
        f"dq_zero_balls{_tail}",
        lambda s, r, m=_mode: table(s, r, "draws").filter(quality.zero_balls(m)).select("draw_idx", *BALLS),
        f"select draw_idx, {_BALLS} from draws where {_ZERO[_mode]}",
        prefix="",
    )
    _add(
        f"dq_unsorted{_tail}",
        lambda s, r, m=_mode: table(s, r, "draws").filter(quality.unsorted_combination(m)).select("draw_idx", "combinaison_croissante"),
        f"select draw_idx, combinaison_croissante from draws where {_unsorted(_mode)}",
        prefix="",
    )
_add(
    "dq_missing_dates",
    lambda s, r: table(s, r, "draws").filter(quality.missing_date()).select("draw_idx", "annee_numero"),
    "select draw_idx, annee_numero from draws where date_tirage is null or date_tirage = ''",
    prefix="",
)
_add(
    "dq_summary",
    lambda s, r: quality.summary(table(s, r, "draws")),
    f"""select *, case when rows > 0 and duplicates + zero_balls + missing_dates + unsorted = 0 then 'SUCCES' else 'ECHEC' end as status from (
    select count(*) as rows, (select count(*) from (select 1 from draws group by trim(annee_numero) having count(*) > 1)) as duplicates,
    count(*) filter ({_ZERO["observed"]}) as zero_balls, count(*) filter (date_tirage is null or date_tirage = '') as missing_dates,
    count(*) filter ({_unsorted("observed")}) as unsorted from draws)""",
    prefix="",
)
_add(
    "dq_errors",
    lambda s, r: quality.errors(table(s, r, "draws")),
    f"""with x as (select count(*) as rows, count(*) filter ({_ZERO["observed"]}) as z, count(*) filter (date_tirage is null or date_tirage = '') as m, count(*) filter ({_unsorted("observed")}) as u from draws)
    select 'Aucun tirage en base — chargez les CSV d''abord.' as error from x where rows = 0 union all select 'Boules a zero detectees' from x where z > 0
    union all select 'Dates manquantes detectees' from x where m > 0 union all select u || ' combinaison(s) non triee(s)' from x where u > 0
    union all (select 'Doublon: ' || coalesce(trim(annee_numero), 'None') from draws group by trim(annee_numero) having count(*) > 1)""",
    prefix="",
)

# loading of files
_WANTED = {f"v{i}": name for i, name in enumerate(LAYOUT)}
_KIND = [kind for _, kind in LAYOUT.values()]
_COLUMN = [col for col, _ in LAYOUT.values()]
_X = "regexp_replace(trim(replace({v}, ',', '.'), ' \u00a0'), '([0-9])_([0-9])', '\\1\\2', 'g')"
_NUM = f"case when regexp_full_match({_X}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast({_X} as double) end"


_INF = f"coalesce(regexp_full_match(lower({_X}), '[+-]?inf(inity)?'), false)"


def _loaded(i: int) -> str:
    v, kind, col = f"v{i}", _KIND[i], _COLUMN[i]
    if kind == "string":
        value = f"trim({v}, ' \u00a0')" if col in ("annee_numero", "jour_tirage") else v
        return f"coalesce({value}, '{'EUR' if col == 'devise' else ''}') as {col}"
    number = _NUM.format(v="coalesce(v29, codes)" if col == "nombre_codes" else v)
    if kind == "double":
        return f"case when {_INF.format(v=v)} then case when {v} like '%-%' then '-infinity'::double else 'infinity'::double end else coalesce({number}, 0) end as {col}"
    return f"coalesce(trunc({number})::bigint, 0) as {col}"


_INFINITE = " or ".join(_INF.format(v="coalesce(v29, codes)" if c == "nombre_codes" else f"v{i}") for i, (k, c) in enumerate(zip(_KIND, _COLUMN)) if k in ("int", "bigint"))
assert list(LAYOUT)[29] == "nombre_de_codes_gagnants"
_FIELD = """("(?:[^"]|"")*"|[^";][^;]*|)"""
#: ld(file_no, row_no, why, columns of tirages): all rows by the loader's rules; fst: the first storable row of each key.
_LOAD = f"""with h as (select file_no, min(regexp_replace(rtrim(line, chr(13) || chr(10)), '^\ufeff', '')) as line from csv_lines where row_no = 0 group by file_no),
hd as (select file_no, list_transform(regexp_extract_all(';' || line, ';{_FIELD}', 1), lambda x: trim(lower(replace(trim(x), '"', '')))) as ns, line from h),
hn as (select file_no, case when line like '%;' then ns[1:len(ns) - 1] else ns end as ns from hd),
r0 as (select file_no, row_no, line, regexp_full_match(line, '{_FIELD}(;{_FIELD})*') as ok from csv_lines where row_no > 0 and trim(line) <> ''),
r1 as (select *, case when ok then list_transform(regexp_extract_all(';' || line, ';{_FIELD}', 1), lambda x: case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) else string_split(line, ';') end as c from r0),
r2 as (select file_no, row_no, case when line like '%;' then c[1:len(c) - 1] else c end as c, ns from r1 join hn using (file_no)),
r3 as (select file_no, row_no, len(c) < len(ns) as short, c[nullif(list_position(ns, 'nombre_codes_gagnants'), 0)] as codes, {", ".join(f"c[nullif(list_position(ns, '{n}'), 0)] as {v}" for v, n in _WANTED.items())} from r2),
r4 as (select file_no, row_no, short, {_INFINITE} as inf, {", ".join(_loaded(i) for i in range(len(LAYOUT)))} from r3),
ld as (select *, case when annee_numero = '' then 'no_key' when short then 'short_row' when inf then 'infinite' when not (numero_chance between 1 and 10 and {_VALID}) then 'out_of_range' end as why from r4),
fst as (select * from ld where why is null qualify row_number() over (partition by annee_numero order by file_no, row_no) = 1)"""
_add("load_rows", lambda s, r: draw_files.load(table(s, r, "csv_lines"))[0], f"{_LOAD} select {', '.join(_COLUMN)} from fst", prefix="")
_add(
    "load_file_counters",
    lambda s, r: draw_files.load(table(s, r, "csv_lines"))[1],
    f"{_LOAD} select a.file_no, a.n as read, coalesce(b.n, 0) as inserted, a.n - coalesce(b.n, 0) as skipped from (select file_no, count(*) as n from ld group by file_no) a left join (select file_no, count(*) as n from fst group by file_no) b using (file_no)",
    prefix="",
)
_add("load_reasons", lambda s, r: draw_files.clean_rows(table(s, r, "csv_lines")).select("file_no", "row_no", "why"), f"{_LOAD} select file_no, row_no, why from ld", prefix="")
_add("line_counts", lambda s, r: draw_files.count_lines(table(s, r, "csv_lines")), "select file_no, count(*) - 1 as n from csv_lines group by file_no", prefix="")
