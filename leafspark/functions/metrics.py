"""Classification metrics as aggregates (counts) and Columns over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confusion(predicted: Column, actual: Column) -> dict[str, Column]:
    """Aggregate columns tp, fp, tn, fn; the positive class is 1."""
    def n(p, a):
        return F.count_if((predicted == p) & (actual == a))
    return {"tp": n(1, 1), "fp": n(1, 0), "tn": n(0, 0), "fn": n(0, 1)}


def _safe(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def rates(tp, fp, tn, fn) -> dict[str, Column]:
    return {"fpr": _safe(fp, fp + tn), "fnr": _safe(fn, tp + fn), "tpr": _safe(tp, tp + fn), "tnr": _safe(tn, tn + fp)}


def scores(tp, fp, tn, fn) -> dict[str, Column]:
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    accuracy = _safe(tp + tn, tp + fp + fn + tn)
    return {"precision": precision, "recall": recall, "f1": _safe(precision * recall, precision + recall) * 2,
            "accuracy": accuracy}


def predictive(tp, fp, tn, fn) -> dict[str, Column]:
    pp, pn = tp + fp, tn + fn
    return {"pp": pp, "pn": pn, "ppv": _safe(tp, pp), "npv": _safe(tn, pn), "fdr": _safe(fp, pp), "fomr": _safe(fn, pn)}


def agreement(tp, fp, tn, fn) -> dict[str, Column]:
    """Matthews, Fowlkes-Mallows, prevalence, likelihood ratios and population."""
    r, p = rates(tp, fp, tn, fn), predictive(tp, fp, tn, fn)
    mcc = F.sqrt(r["tpr"] * r["tnr"] * p["ppv"] * p["npv"]) - F.sqrt(r["fnr"] * r["fpr"] * p["fomr"] * p["fdr"])
    population = tp + fp + tn + fn
    return {"mcc": mcc, "fm": F.sqrt(p["ppv"] * r["tpr"]), "prevalence": _safe(tp + fn, population),
            "lr_plus": _safe(r["tpr"], r["fpr"]), "lr_minus": _safe(r["fnr"], r["tnr"]), "population": population}


def field_rates(tp, fp, tn, fn) -> dict[str, Column]:
    """Percent of crop taken for weed, and of weed found."""
    return {"miss_rate": _safe(fp, fp + tn) * 100, "hit_rate": _safe(tp, tp + fn) * 100}
