"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of words with the document's subject as their class. Frequent patterns
are grown in parallel: a transaction is dealt to each of its words with the words before it in order of frequency, and
each word's share is mined on its own. Rules words -> subject that a more general rule makes redundant are pruned. A
sentence is scored by the evidence of the rules it matches, and the evidence is calibrated on every labelled document by
rules that were mined without it. A document treats the subjects that at least a quarter of its sentences with a subject treat.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import spread, spread_join
from ..session import cut
from .leakage import Folding

#: Up to so many labelled documents their labels are sent to all executors; more are joined to the texts by shuffle.
LABELS_SENT = 250_000
#: Parts of the labelled documents; the documents of each are judged by the rules of the others to calibrate.
FOLDS = 5
#: Fewest sentences and documents of a rule's words, least confidence of a rule, and of the words a pair is made of.
MIN_COUNT, MIN_DOCUMENTS, MIN_CONFIDENCE, MIN_PART = 4, 3, 0.5, 0.3
#: A rule must beat chance, and a pair the rules of its words, by so many standard deviations.
DEVIATIONS = 3.0
#: Most words of a rule; patterns are not grown beyond it.
LONGEST_RULE = 2
SHARE = 0.25
#: A sentence is mined under the subject seen in it if so many rules speak for it, and it is ahead by so much (log odds).
CLEAR_RULES, CLEAR = 2, 0.7
_SENTENCE = re.compile(r"[^.!\n]+(?:[.!]|(?<=\?)(?=[ \t]*(?:\n|$)))")


def sentence_words(text: str, folding: Folding) -> list[list[str]]:
    """Distinct words of every sentence: what ends with a full stop or exclamation mark in one line.

    A question belongs to the sentence that answers it in the same line, or is one of its own at the line's end.
    Menus and titles end with none and give no sentence. Case and accents are ignored, numbers and names in capitals
    inside a sentence carry no subject and rarely pass the support that a rule needs.
    """
    out = []
    for s in _SENTENCE.findall(text):
        words = {w for w in s.translate(folding).split() if not w.isdigit()}
        if words:
            out.append(sorted(words))
    return out


def sentences(texts: DataFrame) -> DataFrame:
    """(doc_id, words, told): one row per sentence of `texts`(doc_id, text, told).

    Sentences of the same words on one page are one: they are not independent, and the tests of rules would take what a
    page repeats for evidence.
    """

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folding = Folding()
        for frame in frames:
            rows = [
                (d, s, told)
                for d, t, told in zip(frame["doc_id"], frame["text"], frame["told"])
                if t
                for s in dict.fromkeys(map(tuple, sentence_words(t, folding)))
            ]
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "words": [list(r[1]) for r in rows], "told": [r[2] for r in rows]})

    return texts.select("doc_id", "text", "told").mapInPandas(cut_up, "doc_id long, words array<string>, told array<string>")


def _beats(hits: Column, n: Column, rate: Column) -> Column:
    """Are `hits` of `n` more than the rate explains, by DEVIATIONS standard deviations?"""
    return hits > n * rate + DEVIATIONS * F.sqrt(n * rate * (1 - rate))


def grow(base: list[tuple[tuple[int, ...], np.ndarray]], pattern: tuple[int, ...], longest: int, least: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(words, counts) of all patterns of at most `longest` words that extend `pattern` in at least `least` transactions
    of some model, out of its conditional base: (words before it, counts by model and class)."""
    if len(pattern) == longest:
        return
    counts: dict[int, np.ndarray] = {}
    for words, n in base:
        for w in words:
            counts[w] = counts[w] + n if w in counts else n
    for w, n in counts.items():
        if n.sum(axis=-1).max() >= least:
            found = (w, *pattern)
            yield found, n
            if len(found) < longest:
                yield from grow([(ws[: ws.index(w)], k) for ws, k in base if w in ws], found, longest, least)


def _classes(rows: DataFrame, subjects: list[str]) -> DataFrame:
    """`rows` with `classes`: for every model the number of the row's subject, or -1 where it is not in the model. A
    column `subject` in its place stands for one model."""
    if "classes" in rows.columns:
        return rows
    number = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")) - 1
    return rows.withColumn("classes", F.array(number.cast("int")))


def patterns(baskets: DataFrame, subjects: list[str], longest: int, least: int = MIN_COUNT, masks: dict[str, int] | None = None) -> DataFrame:
    """(model, words, subject, n, freq): every pattern of one to `longest` words in at least `least` of a model's `baskets`
    (words, and subject or classes), with its transactions and those of each subject that it comes with.

    `masks` gives the words to use, frequent ones first, and the models of each as bits. Equal transactions are counted
    before they are dealt to their words, and no pattern is grown beyond `longest`, however long a transaction is.
    """
    baskets = _classes(baskets, subjects)
    if masks is None:
        ranks = baskets.select(F.explode("words").alias("word")).groupBy("word").count()
        # a dictionary: the words that reach the support of a rule
        masks = {r["word"]: -1 for r in ranks.filter(F.col("count") >= least).orderBy(F.desc("count"), "word").collect()}
    known = list(masks)
    place = {w: i for i, w in enumerate(known)}
    shared = baskets.sparkSession.sparkContext.broadcast((place, known, list(masks.values())))

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, _, _ = shared.value
        for frame in frames:
            rows = [sorted({place[w] for w in ws if w in place}) for ws in frame["words"]]
            out = pd.DataFrame({"items": rows, "classes": frame["classes"].to_numpy()})
            yield out[[bool(r) for r in rows]]

    items = baskets.select("words", "classes").mapInPandas(ranked, "items array<int>, classes array<int>")
    alike = items.groupBy("items", "classes").agg(F.count(F.lit(1)).alias("k"))
    dealt = alike.select("classes", "k", "items", F.posexplode("items").alias("at", "word"))
    before = F.slice("items", F.lit(1), F.col("at")).alias("before")
    dealt = dealt.select("word", before, "classes", "k").groupBy("word", "before", "classes").agg(F.sum("k").alias("k"))

    def mined(frame: pd.DataFrame) -> pd.DataFrame:
        _, known, masks = shared.value
        base: dict[tuple[int, ...], np.ndarray] = {}
        for before, classes, k in zip(frame["before"], frame["classes"], frame["k"]):
            counts = base.setdefault(tuple(before.tolist()), np.zeros((len(classes), len(subjects)), dtype=np.int64))
            for m, c in enumerate(classes):
                if c >= 0:
                    counts[m, c] += k
        word = int(frame["word"].iloc[0])
        own = np.sum(list(base.values()), axis=0)
        rows = []
        for found, n in [((word,), own), *grow(list(base.items()), (word,), longest, least)]:
            words = sorted(known[w] for w in found)
            for m, of in enumerate(n.sum(axis=1).tolist()):
                if of >= least and all(masks[w] >> m & 1 for w in found):
                    rows += [(m, words, subjects[c], of, int(n[m, c])) for c in np.flatnonzero(n[m])]
        return pd.DataFrame(rows, columns=["model", "words", "subject", "n", "freq"])

    schema = "model int, words array<string>, subject string, n long, freq long"
    return spread(dealt, "word").groupBy("word").applyInPandas(mined, schema)


def priors_of(transactions: DataFrame, subjects: list[str]) -> dict[int, dict[str, float]]:
    """Share of each subject in the transactions of each model."""
    alike = transactions.groupBy("classes").agg(F.count(F.lit(1)).alias("k"))
    # one row per model and subject: their number is fixed by the table `subjects`
    rows = alike.select("k", F.posexplode("classes").alias("model", "c")).filter("c >= 0").groupBy("model", "c").agg(F.sum("k").alias("k")).collect()
    total: Counter[int] = Counter()
    for r in rows:
        total[r["model"]] += r["k"]
    out: dict[int, dict[str, float]] = {}
    for r in sorted(rows):
        out.setdefault(r["model"], {})[subjects[r["c"]]] = r["k"] / total[r["model"]]
    return out


def mine(transactions: DataFrame, longest: int = LONGEST_RULE, subjects: list[str] | None = None, priors: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """(model, words, subject, n, confidence) of the rules of each model of `transactions`(doc_id, words, and subject or
    classes), pruned. All models are mined at once, and each has the rules that mining it on its own would give.

    Patterns of at most `longest` words are grown over the words that come with one subject clearly more often than at
    large, in more than a few documents; a word that tells nothing on its own is in no rule. A rule is redundant unless
    it beats the rules of all its words but one.
    """
    spark = transactions.sparkSession
    if subjects is None:
        subjects = [r[0] for r in transactions.select("subject").distinct().orderBy("subject").collect()]
    if not subjects:
        return spark.createDataFrame([], "model int, words array<string>, subject string, n long, confidence double")
    transactions = _classes(transactions, subjects)
    priors = priors_of(transactions, subjects) if priors is None else priors
    shares = [(m, subjects.index(s), s, p) for m, own in priors.items() for s, p in own.items()]
    by_class = F.broadcast(spark.createDataFrame(shares, "model int, c int, subject string, prior double"))
    each = transactions.select("doc_id", F.explode("words").alias("word"), "classes").groupBy("word", "doc_id", "classes").agg(F.count("*").alias("k"))
    word = each.select("word", "doc_id", "k", F.posexplode("classes").alias("model", "c")).filter("c >= 0").groupBy("word", "model", "c", "doc_id")
    word = word.agg(F.sum("k").alias("k")).groupBy("word", "model", "c").agg(F.sum("k").alias("k"), F.count("*").alias("docs"))
    # at most one row per subject in each
    all_ = W.partitionBy("word", "model")
    word = word.withColumn("n", F.sum("k").over(all_)).withColumn("docs", F.sum("docs").over(all_)).join(by_class, ["model", "c"])
    telling = (F.col("k") >= MIN_PART * F.col("n")) & _beats(F.col("k"), F.col("n"), F.col("prior"))
    useful = word.filter(telling & (F.col("n") >= MIN_COUNT) & (F.col("docs") >= MIN_DOCUMENTS)).groupBy("word", "model").agg(F.max("n").alias("n"))
    useful = useful.groupBy("word").agg(F.sum(F.expr("shiftleft(1L, model)")).alias("mask"), F.max("n").alias("n"))
    # a dictionary: the words that tell a subject
    masks = {r["word"]: r["mask"] for r in useful.orderBy(F.desc("n"), "word").collect()}
    # the subject of a rule is an item as its words are: together they need the support, too
    ruled = cut(patterns(transactions, subjects, longest, MIN_COUNT, masks).filter(F.col("freq") >= MIN_COUNT))
    rate = ruled.select("model", "words", "subject", (F.col("freq") / F.col("n")).alias("rate"))
    parts = ruled.filter(F.size("words") > 1).withColumn("part", F.explode(F.transform("words", lambda w: F.array_remove("words", w))))
    longer = parts.join(rate.withColumnRenamed("words", "part"), ["model", "part", "subject"], "left").groupBy("model", "words", "subject", "n", "freq")
    longer = longer.agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("rate"))
    alone = ruled.filter(F.size("words") == 1).join(by_class, ["model", "subject"]).select("model", "words", "subject", "n", "freq", F.col("prior").alias("rate"))
    rules = alone.unionByName(longer).filter((F.col("freq") >= MIN_CONFIDENCE * F.col("n")) & _beats(F.col("freq"), F.col("n"), F.col("rate")))
    return rules.select("model", "words", "subject", "n", (F.col("freq") / F.col("n")).alias("confidence"))


def pooled(blocks: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """(least margin, right, all) of the blocks that remain once neighbours are pooled until the share of right ones rises.

    Blocks of parts of the margins pooled again give what pooling all at once gives.
    """
    out: list[tuple[float, int, int]] = []
    for block in sorted(blocks):
        out.append(block)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, right, n = out.pop()
            out[-1] = (out[-1][0], out[-1][1] + right, out[-1][2] + n)
    return out


def calibration(judged: DataFrame) -> tuple[list[tuple[float, int, int]], float]:
    """(blocks, best) of all rows of `judged`(margin, right boolean): blocks pooled within ranges of the margin, and the
    share of right rows among those not below the median margin. No task and no driver sees more than a range."""
    alike = judged.groupBy("margin").agg(F.sum(F.col("right").cast("long")).alias("right"), F.count(F.lit(1)).alias("n"))
    ranged = cut(alike.repartitionByRange("margin").withColumn("part", F.spark_partition_id()))

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for frame in frames for r in frame.itertuples(index=False)]
        yield pd.DataFrame([(*b, rows[0][3]) for b in pooled([r[:3] for r in rows])], columns=["margin", "right", "n", "part"])

    found = [tuple(r) for r in ranged.mapInPandas(pool, "margin double, right long, n long, part int").collect()]
    if not found:
        return [], 1.0
    sizes: Counter[int] = Counter()
    for _, _, n, part in found:
        sizes[part] += n
    total = sum(sizes.values())
    middle = []
    for place in ((total - 1) // 2, total // 2):
        part = next(p for p in sorted(sizes) if place < sum(n for q, n in sizes.items() if q <= p))
        before = sum(n for q, n in sizes.items() if q < part)
        run = F.sum("n").over(W.partitionBy("part").orderBy("margin"))
        own = ranged.filter(F.col("part") == part).withColumn("run", run).filter(F.col("run") > place - before)
        middle.append(own.agg(F.min("margin")).first()[0])
    upper = ranged.filter(F.col("margin") >= sum(middle) / 2).agg(F.sum("right"), F.sum("n")).first()
    return [b[:3] for b in found], upper[0] / upper[1]


class Rules:
    """Rules as a lookup table, and the steps from evidence to the probability that a sentence treats its subject."""

    def __init__(self, rules: list[tuple[list[str], str, int, float]], priors: dict[str, float]):
        self.subjects = sorted(priors)
        self.steps: list[tuple[float, float]] = []
        self.best = 1.0
        place = {s: i for i, s in enumerate(self.subjects)}
        self.weights: dict[str | tuple[str, ...], np.ndarray] = {}
        floor = 0.02
        for words, subject, n, confidence in rules:
            key = words[0] if len(words) == 1 else tuple(words)
            w = self.weights.setdefault(key, np.zeros(len(place)))
            sure = (confidence * n + priors[subject]) / (n + 1)
            w[place[subject]] = math.log(max(sure, floor) / priors[subject])
        self.longest = max((len(k) for k in self.weights if isinstance(k, tuple)), default=1)
        self.pair_words = {w for k in self.weights if isinstance(k, tuple) for w in k}

    def evidence(self, words: list[str]) -> tuple[int, float, int]:
        """Best subject (its number, or -1 without any rule), how far its evidence is ahead of the second, and how
        many rules speak for it."""
        found = [self.weights[w] for w in words if w in self.weights]
        paired = [w for w in words if w in self.pair_words]
        for k in range(2, self.longest + 1):
            found += [self.weights[p] for p in combinations(paired, k) if p in self.weights]
        if not found:
            return -1, 0.0, 0
        score = np.sum(found, axis=0)
        order = np.argsort(score, kind="stable")
        best = int(order[-1])
        ahead = score[best] - (score[order[-2]] if len(order) > 1 else 0.0)
        return best, float(ahead), sum(bool(w[best] > 0) for w in found)

    def calibrate(self, blocks: list[tuple[float, int, int]], best: float) -> None:
        """Monotone steps from evidence to probability; `best` is the share of right sentences of the surer half."""
        if blocks:
            self.steps = [(-math.inf, 0.0)] + [(m, r / n) for m, r, n in pooled(blocks)]
            self.best = best

    def threshold(self, at_least: float) -> float:
        """Smallest evidence whose calibrated probability reaches `at_least` of that of the surer half.

        A page treats more than its label tells, so that even sure sentences are "right" less than always.
        """
        return next((m for m, p in self.steps if p >= at_least * self.best), CLEAR)


def fit(documents: DataFrame, labels: DataFrame, longest: int = LONGEST_RULE) -> Rules | None:
    """Rules of at most `longest` words from all sentences of all labelled documents; None without labels.

    Mined twice: first with the document's labels as classes of all its sentences, then with the subject that the
    first rules see in a sentence, as a page mixes subjects and labels may be wrong. Beside the rules of all documents
    those without each of the FOLDS parts are mined in the same passes; they judge the part they do not know, so that
    every labelled document counts for the rules and for the calibration alike.
    """
    given = labels.filter("subject is not null and doc_id is not null").select("doc_id", "subject")
    told = cut(given.groupBy("doc_id").agg(F.collect_set("subject").alias("told")))
    texts = spread_join(documents.select("doc_id", "text"), told, "doc_id", LABELS_SENT).filter("told is not null")
    sample = cut(sentences(texts).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")))
    subjects = [r[0] for r in told.select(F.explode("told").alias("s")).distinct().orderBy("s").collect()]
    number = F.array_position(F.array(*map(F.lit, subjects)), F.col("s")).cast("int") - 1
    classes = F.array(*[F.when(F.col("fold") == m, -1).otherwise(number) for m in range(FOLDS)], number)
    first = _models(sample.withColumn("s", F.explode("told")).withColumn("classes", classes), subjects, longest)
    if FOLDS not in first:
        return None
    second = _models(cut(_seen(sample, first, subjects)), subjects, longest)
    models = {**first, **second}
    models[FOLDS].calibrate(*calibration(_judged(sample, models)))
    return models[FOLDS]


def _models(transactions: DataFrame, subjects: list[str], longest: int) -> dict[int, Rules]:
    """The rules of each model that has transactions."""
    priors = priors_of(transactions, subjects)
    found: dict[int, list] = {m: [] for m in priors}
    if found:
        # the models, which every executor holds: dictionaries of the words that tell a subject, and of their pairs
        for m, *rule in mine(transactions.select("doc_id", "words", "classes"), longest, subjects, priors).collect():
            found[m].append(tuple(rule))
    return {m: Rules(rules, priors[m]) for m, rules in found.items()}


def _seen(sample: DataFrame, models: dict[int, Rules], subjects: list[str]) -> DataFrame:
    """(doc_id, words, classes): the subject that the rules of each model see in a sentence, -1 where it is not clear and
    in the model without the sentence's part."""
    shared = sample.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = pickle.loads(shared.value)
        place = {s: i for i, s in enumerate(subjects)}
        for frame in frames:
            classes = []
            for words, fold in zip(frame["words"], frame["fold"]):
                own = [-1] * (FOLDS + 1)
                for m, known in models.items():
                    if m != fold:
                        i, margin, n = known.evidence(words)
                        if n >= CLEAR_RULES and margin >= CLEAR:
                            own[m] = place[known.subjects[i]]
                classes.append(own)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "words": frame["words"], "classes": classes})

    return sample.select("doc_id", "words", "fold").mapInPandas(judge, "doc_id long, words array<string>, classes array<int>")


def _judged(sample: DataFrame, models: dict[int, Rules]) -> DataFrame:
    """(margin, right) of every sentence that rules speak for which were mined without its part: is the subject with the
    most evidence, however little it is ahead, one that the document's labels tell?"""
    shared = sample.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = pickle.loads(shared.value)
        for frame in frames:
            rows = []
            for words, told, fold in zip(frame["words"], frame["told"], frame["fold"]):
                i, margin, n = models[fold].evidence(words) if fold in models else (-1, 0.0, 0)
                if n >= CLEAR_RULES:
                    rows.append((margin, models[fold].subjects[i] in told))
            yield pd.DataFrame(rows, columns=["margin", "right"])

    return sample.select("words", "told", "fold").mapInPandas(judge, "margin double, right boolean")


def assign(documents: DataFrame, rules: Rules | None, share: float = SHARE, sure: float = 0.6) -> DataFrame:
    """(doc_id, subject, n, of): the subjects that at least `share` of a document's sentences with a subject treat.

    A sentence treats the subject with the most evidence if at least CLEAR_RULES rules speak for it and the
    calibrated probability reaches `sure` of that of the surer half.
    Documents without such sentences, null or empty texts, and a missing model give no rows.
    """
    schema = "doc_id long, subject string, n int, of int"
    if rules is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps((rules, rules.threshold(sure))))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, least = pickle.loads(shared.value)
        folding = Folding()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                counts: dict[int, int] = {}
                for words in sentence_words(text, folding) if text else ():
                    i, margin, n = known.evidence(words)
                    if n >= CLEAR_RULES and margin >= least:
                        counts[i] = counts.get(i, 0) + 1
                of = sum(counts.values())
                rows += [(doc, known.subjects[i], n, of) for i, n in counts.items() if n >= share * of]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "n", "of"])

    return documents.select("doc_id", "text").mapInPandas(score, schema)
