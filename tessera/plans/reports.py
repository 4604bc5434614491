"""Markdown of small results (a handful of rows each, collected by the caller)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def table(columns: list[str], rows: Iterable[Iterable[object]]) -> str:
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "|".join("---" for _ in columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join(map(show, row)) + " |" for row in rows])


def classification(per_label: list[Mapping], overall: Mapping, cells: list[Mapping]) -> str:
    """Label metrics, the overall line and the confusion matrix."""
    labels = [r["label"] for r in per_label]
    count = {(c["gold"], c["pred"]): c["n"] for c in cells}
    head = f"Accuracy {overall['accuracy']:.3f}, macro F1 {overall['macro_f1']:.3f}, weighted F1 {overall['weighted_f1']:.3f}, {overall['n']} cases."
    first = table(["Label", "Precision", "Recall", "F1", "Support"], ([r[k] for k in ("label", "precision", "recall", "f1", "support")] for r in per_label))
    second = table(["Gold \\ predicted", *labels], ([g, *(count.get((g, p), 0) for p in labels)] for g in labels))
    return "\n\n".join([head, first, second])


def rankers(means: list[Mapping], cuts: Iterable[int]) -> str:
    """One line per run, with the change of MRR against the run before."""
    columns = ["Run", "MRR", "Change", *(f"{m} @{k}" for k in cuts for m in ("Hit", "Recall", "nDCG"))]
    rows = [[r["run"], r["mrr"], r.get("mrr_delta"), *(r[f"{m}_{k}"] for k in cuts for m in ("hit", "recall", "ndcg"))] for r in means]
    return table(columns, rows)


def single_ranker(mean: Mapping, cuts: Iterable[int]) -> str:
    return f"{mean['run']}: MRR {mean['mrr']:.3f} over {mean['queries']} queries.\n\n" + table(["Cut", "Hit", "Recall", "Precision", "nDCG"], ([k, *(mean[f"{m}_{k}"] for m in ("hit", "recall", "precision", "ndcg"))] for k in cuts))


def quality(metrics: Mapping, weights: list[tuple[str, float]]) -> str:
    head = f"Accuracy {metrics['accuracy']:.3f} (majority {metrics['majority']:.3f}), precision {metrics['precision']:.3f}, recall {metrics['recall']:.3f}, F1 {metrics['f1']:.3f}."
    return head + "\n\n" + table(["Feature", "Weight"], weights)
