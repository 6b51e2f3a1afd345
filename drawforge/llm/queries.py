"""Registered queries of the operators for training data (problems 1, 6, 7 and 8)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BALLS, MAX_BALL, NUM_CHANCE_MAX
from ..functions.text import strip
from ..session import cut
from ..sources.tables import table
from . import leakage, packing, pairs, subjects
from .tokens import token_counts

#: The capacity for which p6_found asks which texts must be split.
SPLIT_CAPACITY = 2048


#: A pair is a case if at least this share of the draws has both balls, and so many times what chance gives.
PAIR_SHARE_PERCENT, PAIR_TIMES = 2, 2
#: False discoveries allowed among the pairs that come out.
PAIR_DISCOVERY = 0.05


def draw_baskets(draws: DataFrame) -> DataFrame:
    """The balls of every valid draw as a basket: per trimmed key the valid row with the smallest draw_idx."""
    balls = F.array(*BALLS)
    valid = (
        F.forall(balls, lambda b: b.isNotNull() & b.between(1, MAX_BALL))
        & (F.size(F.array_distinct(balls)) == len(BALLS))
        & F.col("numero_chance").between(1, NUM_CHANCE_MAX)
    )
    # six bits a ball: the aggregate keeps two numbers a key and needs no sort
    code = sum((F.shiftleft(F.col(b).cast("long"), 6 * i) for i, b in enumerate(BALLS)), F.lit(0).cast("long"))
    first = draws.filter(valid).groupBy(strip(F.col("annee_numero")).alias("key")).agg(F.min_by(code, "draw_idx").alias("code"))
    items = F.array_sort(F.array(*[F.shiftright("code", 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(len(BALLS))]))
    return first.filter("key is not null").select(
        items.alias("items"), F.lit(None).cast("array<int>").alias("others"), F.lit(len(BALLS)).cast("long").alias("size")
    )


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs within the two limits that are discoveries, too: from some 2,600 draws on the limits cannot be met by chance
    as often as PAIR_DISCOVERY allows, so that there it takes no pair away."""
    found = pairs.pair_surprise(draw_baskets(table(spark, root, "draws")))
    often = F.col("n_ab") * 100 >= PAIR_SHARE_PERCENT * F.col("n")
    more = F.col("n") * F.col("n_ab") >= PAIR_TIMES * F.col("n_a") * F.col("n_b")
    surprising = F.col("log_q") <= math.log(PAIR_DISCOVERY)
    return found.filter(often & more & surprising).select(F.col("item_a").alias("ball_a"), F.col("item_b").alias("ball_b"))


def p1_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of balls with its count and expectation."""
    found = pairs.pair_surprise(draw_baskets(table(spark, root, "draws")))
    rounded = [F.round(c, 4).alias(c) for c in ("expected", "ratio")]
    return found.select(F.col("item_a").alias("ball_a"), F.col("item_b").alias("ball_b"), "n_ab", "n_a", "n_b", "n", *rounded)


def p1_surprise(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of balls with its tail and adjusted tail, as logarithms."""
    found = pairs.pair_surprise(draw_baskets(table(spark, root, "draws")))
    return found.select(F.col("item_a").alias("ball_a"), F.col("item_b").alias("ball_b"), F.round("log_p", 6).alias("log_p"), F.round("log_q", 6).alias("log_q"))


def _ticket_pairs(spark: SparkSession, root: str) -> DataFrame:
    bought = table(spark, root, "tickets").select(F.struct("draw_idx", "strategy").alias("basket"), F.col("ball").alias("item"))
    return pairs.pair_surprise(pairs.baskets_of(bought, "basket", "item"))


def p1_ticket_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The same for the balls on all tickets of one draw and strategy (none is one, too), which are baskets of any size."""
    return _ticket_pairs(spark, root).select("item_a", "item_b", "n_ab", F.round("ratio", 6).alias("ratio"), F.round("log_q", 6).alias("log_q"))


def p1_ticket_counts(spark: SparkSession, root: str) -> DataFrame:
    """The exact counts behind p1_ticket_pairs."""
    return _ticket_pairs(spark, root).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    sizes = token_counts(table(spark, root, "documents"))
    return packing.pack(sizes, SPLIT_CAPACITY).filter("n_pieces > 1").select("doc_id").distinct()


def p6_packing(spark: SparkSession, root: str) -> DataFrame:
    """Bins, bounds and unused space for every capacity of `pack_sizes`, over all documents."""
    sizes = cut(token_counts(table(spark, root, "documents")))
    reports = [
        packing.report(packing.pack(sizes, r.capacity_tokens), r.capacity_tokens).select(F.lit(r.size_id).alias("size_id"), "*")
        for r in table(spark, root, "pack_sizes").orderBy("size_id").collect()  # three rows, fixed
    ]
    return reduce(DataFrame.unionByName, reports)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    rules = subjects.fit(documents, table(spark, root, "subject_labels"))
    return subjects.assign(documents, rules).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents and sentences of each subject in the corpus."""
    documents = table(spark, root, "documents")
    rules = subjects.fit(documents, table(spark, root, "subject_labels"))
    return subjects.assign(documents, rules).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_surprise, p1_ticket_pairs, p1_ticket_counts, p6_found, p6_packing, p7_found, p8_found, p8_composition)}

_VALID = " and ".join(f"{b} between 1 and 49" for b in BALLS)
_WORDS = "list_filter(string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_RUNS = "select {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as run from (select {id}, {words} as w from {table})"

_PAIRS = f"""
    with v as (select draw_idx, trim(annee_numero) as k, [{", ".join(BALLS)}] as b from draws where {_VALID} and numero_chance between 1 and 10),
    u as (select * from v where len(list_distinct(b)) = 5 qualify row_number() over (partition by k order by draw_idx) = 1),
    o as (select k, unnest(b) as ball from u), f as (select ball, count(*) as n from o group by ball), t as (select count(*) as n from u),
    p as (select x.ball as ball_a, y.ball as ball_b, count(*) as n_ab from o x join o y on x.k = y.k and x.ball < y.ball group by 1, 2),
    a as (select ball_a, ball_b, n_ab, fa.n as n_a, fb.n as n_b, t.n from p join f fa on fa.ball = ball_a join f fb on fb.ball = ball_b cross join t)"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_PAIRS} select ball_a, ball_b from a where n_ab * 100 >= 2 * n and n * n_ab >= 2 * n_a * n_b",
    # all baskets have five items, so that an item of frequency f is in each with probability f / n
    "p1_pairs": f"{_PAIRS} select *, round(n_a * n_b / n, 4) as expected, round(n_ab / (n_a * n_b / n), 4) as ratio from a",
    "p1_ticket_counts": """
    with o as (select distinct dense_rank() over (order by draw_idx, strategy) as k, ball from tickets where ball is not null),
    f as (select ball, count(*) as n from o group by ball)
    select x.ball as item_a, y.ball as item_b, count(*) as n_ab, any_value(fa.n) as n_a, any_value(fb.n) as n_b, (select count(distinct k) from o) as n
    from o x join o y on x.k = y.k and x.ball < y.ball join f fa on fa.ball = x.ball join f fb on fb.ball = y.ball group by 1, 2""",
    "p7_found": f"""
    with d as ({_RUNS.format(id="doc_id", words=_WORDS.format("text"), table="documents")}),
    e as ({_RUNS.format(id="item_id", words=_WORDS.format("passage"), table="eval_items")})
    select distinct doc_id, item_id from d join e using (run)""",
}
