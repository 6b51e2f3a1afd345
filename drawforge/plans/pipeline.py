"""The whole analysis: facades that bundle the operators, and the text and JSON reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, combos, frequency, markov, periodicity, prizes, quality, stats, strategies
from ..operators.views import ordered_draws
from ..schema import MAX_BALL, NUM_BALLS
from ..session import cut


def full_analysis(draws: DataFrame, order: str = "text") -> dict[str, DataFrame]:
    """Lazy results of the analysis stage, over `draws` in the layout of the draws table."""
    d = ordered_draws(draws, order)
    hot, cold = frequency.hot_cold(d)
    return {
        "draws": d,
        "overall": frequency.overall(d),
        "by_position": frequency.by_position(d),
        "recency": frequency.recency(d),
        "pairs": combos.pair_counts(d),
        "triplets": combos.triplets(d, 30),
        "correlation": stats.spearman_positions(d),
        "sum": stats.sum_distribution(d),
        "decades": stats.decade_distribution(d),
        "parity": stats.parity_distribution(d),
        "chance": frequency.chance_overall(d),
        "chance_by_day": frequency.chance_by_day(d),
        "by_day": frequency.draws_by_day(d),
        "gaps": frequency.gaps(d),
        "hot_numbers": hot,
        "cold_numbers": cold,
    }


def modelling(ordered: DataFrame, clusters_wanted: int = 5) -> dict[str, DataFrame]:
    """Lazy results of the modelling stage; no clusters where the draws are too few for them."""
    trans = markov.transitions(ordered)
    out = {
        "markov": trans,
        "markov_predictions": markov.predict_next(ordered, trans),
        "anomalies": stats.anomalies(ordered, 2.5),
        "significant_pairs": combos.pair_significance(ordered).filter("p05").orderBy(F.desc("cnt"), "a", "b").limit(20),
    }
    try:
        out["cluster_profiles"] = clusters.profiles(clusters.assign(ordered, clusters_wanted, "di"))
    except ValueError:
        pass
    return out


def backtests(ordered: DataFrame) -> dict[str, DataFrame]:
    return {"strategies": strategies.backtest(ordered, strategies.STRATEGIES), "chance": strategies.chance_backtest(ordered)}


def prize_analysis(tirages: DataFrame | None) -> dict:
    """Ranks with their returns, frequencies and odds, and the number of draws; no ranks where there is no table."""
    if tirages is None:
        return {"by_rank": None, "total_draws": 0}
    return {"by_rank": prizes.by_rank(tirages), "total_draws": tirages.count()}


def periodicity_analysis(ordered: DataFrame) -> dict[str, DataFrame]:
    return {"series": periodicity.ball_series(ordered), "acf": periodicity.acf(ordered), "periods": periodicity.dft_peaks(ordered), "summary": periodicity.summary(ordered)}


def validation(rows: DataFrame | None, lines: DataFrame | None = None, mode: str = "observed", most: int = 1000) -> dict:
    """Validation report: status, total_csv_lines where the files' lines are given, errors_count, and errors, of which
    the first `most` are listed. No table is an error, too."""
    if rows is None:
        found, count = ["Base introuvable — chargez les fichiers d'abord."], 1
    else:
        faults = cut(quality.errors(rows, mode))
        count = faults.count()
        found = [r["error"] for r in faults.orderBy("error").limit(most).collect()]
    out = {"status": "ECHEC" if count else "SUCCES", "errors_count": count, "errors": found}
    if lines is not None:
        out["total_csv_lines"] = lines.filter("row_no > 0").count()
    return out


def write_validation(report: dict, folder: str) -> int:
    """validation_report.json in a folder of the driver; the exit code of the report, 0 for success."""
    with open(f"{folder}/validation_report.json", "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
    return 0 if report["status"] == "SUCCES" else 1


def _part(stage: str, made: Callable[[], dict]) -> dict:
    """What a stage gives, or the reason why it gives nothing: a stage that fails does not stop the others."""
    try:
        return made()
    except Exception as e:  # reported, not hidden
        return {f"{stage}_error": f"{type(e).__name__}: {e}"[:500]}


def _rows(df: DataFrame, n: int) -> list[dict]:
    return [r.asDict() for r in df.limit(n).collect()]


def bundle(draws: DataFrame, order: str = "text") -> dict:
    """The small results of all stages as plain values, at most a few dozen rows each; of a stage that fails, its error."""
    a = full_analysis(draws, order)
    d = cut(a["draws"])

    def frequencies() -> dict:
        return {
            "frequencies": _rows(a["overall"].orderBy("cnt", "ball"), MAX_BALL)[::-1],
            "hot": _rows(a["hot_numbers"].orderBy("rank"), 10),
            "cold": _rows(a["cold_numbers"].orderBy("rank"), 10),
            "distribution": {"sum": _rows(a["sum"], 1)[0], "decades": _rows(a["decades"], 5), "parity": _rows(a["parity"], 1)[0]},
            "triplets": _rows(a["triplets"].orderBy("rank"), 10),
        }

    def models() -> dict:
        m = modelling(d)
        return {
            "markov": _rows(m["markov_predictions"].orderBy("rank"), 10),
            "anomalies_count": m["anomalies"].count(),
            "significant_pairs_count": m["significant_pairs"].count(),
        }

    def played() -> dict:
        b = backtests(d)
        return {"strategies": _rows(b.get("strategies", []), 10), "chance": _rows(b.get("chance", []), 3)}

    return {"draws": d.count()} | _part("analysis", frequencies) | _part("models", models) | _part("backtests", played)


def text_report(b: dict, at: datetime | None = None) -> str:
    """The bundle as a readable report."""
    total = comb(MAX_BALL, NUM_BALLS)
    s = b.get("distribution", {}).get("sum") or {"mean": None}
    lines = ["RAPPORT D'ANALYSE DES TIRAGES", f"Généré le {(at or datetime.now()):%Y-%m-%d %H:%M:%S}", "", f"Tirages analysés : {b['draws']}", "", "Numéros les plus fréquents"]
    lines += [f"  {r['ball']} : {r['cnt']}" for r in b.get("frequencies", [])[:10]]
    lines += ["Numéros les moins fréquents"] + [f"  {r['ball']} : {r['cnt']}" for r in b.get("frequencies", [])[-5:]]
    if s["mean"] is not None:
        lines += ["", f"Somme : moyenne {s['mean']:.1f}, écart-type {s['std']:.1f}, de {s['min']} à {s['max']}, médiane {s['median']:.1f}"]
    lines += ["", "Triplets fréquents"] + [f"  {r['a']}, {r['b']}, {r['c']} : {r['cnt']}" for r in b.get("triplets", [])]
    for title, key in (("Numéros chauds", "hot"), ("Numéros froids", "cold")):
        lines += ["", title] + [f"  {r['ball']} : {r['cnt']}" for r in b.get(key, [])[:5]]
    lines += ["", "Prédictions de Markov"] + [f"  {r['ball']} : {r['score']:.4f}" for r in b.get("markov", [])]
    lines += ["", f"Anomalies : {b.get('anomalies_count', '-')}", "", "Stratégies"]
    lines += [f"  {r['strategy']} : investi {r['invested']:.2f}, gagné {r['won']}, ROI {r['roi_pct']:.2f} %, gain max {r['max_win']}" for r in b.get("strategies", [])]
    lines += ["", "Numéro chance"] + [f"  {r['method']} : ROI {r['roi_pct']:.2f} %, au hasard {r['random_roi_pct']:.2f} %, écart {r['improvement']:+.2f}" for r in b.get("chance", [])]
    lines += ["", f"Combinaisons possibles : {total:,}", f"  5 bons et chance : 1/{total * 10:,}", f"  5 bons : 1/{total:,}"]
    lines += [f"{k} : {v}" for k, v in b.items() if k.endswith("_error")]
    return "\n".join(lines) + "\n"


def write_report(b: dict, folder: str) -> None:
    """report.txt and results.json in a folder of the driver."""
    with open(f"{folder}/report.txt", "w", encoding="utf-8") as f:
        f.write(text_report(b))
    with open(f"{folder}/results.json", "w", encoding="utf-8") as f:
        json.dump(b, f, ensure_ascii=False, indent=2, default=str)
