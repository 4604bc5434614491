"""Claims, their verdicts, and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VERIFY_STOP, col, content_tokens, unfenced, verdict

LABELS = ("entailed", "baseless", "contradicted")
MAX_CLAIMS = 6
ENTAIL_SHARE = 0.6


def support(answer: str, contexts: Column) -> Column:
    """Share of the answer's content tokens found in the union of the contexts' (``array<string>``); null if it has none."""
    c = content_tokens(F.array_join(contexts, " "), VERIFY_STOP)
    share = lambda a: F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a))
    return F.transform(F.array(content_tokens(answer, VERIFY_STOP)), share)[0]


def shares(claims: Column, contexts: Column) -> Column:
    """For each claim the share of its content tokens found in each context, as nested arrays; 0 where it has none.

    Tokens of each text are made once a row, whatever the number of pairs.
    """
    held = F.transform(contexts, lambda c: content_tokens(c, VERIFY_STOP))

    def against(held: Column) -> Column:
        share = lambda a, c: F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a)).otherwise(0.0)
        one = lambda a: F.transform(held, lambda c: share(a, c))
        return F.transform(claims, lambda x: F.transform(F.array(content_tokens(x, VERIFY_STOP)), one)[0])

    return F.transform(F.array(held), against)[0]


def lexical_verdict(share: Column) -> Column:
    return F.when(share >= ENTAIL_SHARE, "entailed").otherwise("baseless")


def _pick(order: tuple[str, ...], code: Column) -> Column:
    return F.when(code == 2, order[2]).when(code == 1, order[1]).otherwise(order[0])


def claim_verdict(verdicts: Column) -> Column:
    """One verdict of a claim's ``array<string>`` of window verdicts, in its row: contradicted beats entailed beats baseless."""
    known = F.transform(verdicts, verdict)
    return F.when(F.array_contains(known, "contradicted"), "contradicted").when(F.array_contains(known, "entailed"), "entailed").otherwise("baseless")


def answer_verdict(verdicts: Column) -> Column:
    """One verdict of an answer's ``array<string>`` of claim verdicts: contradicted beats baseless beats entailed; none is baseless."""
    known = F.transform(verdicts, verdict)
    entailed = (F.size(known) > 0) & ~F.array_contains(known, "baseless")
    return F.when(F.array_contains(known, "contradicted"), "contradicted").when(entailed, "entailed").otherwise("baseless")


def over_windows(verdicts: DataFrame, claim_keys: list[str], verdict_col: str) -> DataFrame:
    """One verdict per claim over its windows: contradicted beats entailed beats baseless."""
    order = ("baseless", "entailed", "contradicted")
    v = verdict(F.col(verdict_col))
    code = F.max(F.when(v == "contradicted", 2).when(v == "entailed", 1).otherwise(0))
    return verdicts.groupBy(*claim_keys).agg(_pick(order, code).alias("verdict"))


def over_claims(answers: DataFrame, verdicts: DataFrame, answer_key: str, verdict_col: str) -> DataFrame:
    """One verdict per answer over its claims: contradicted beats baseless beats entailed; no claim is baseless."""
    order = ("entailed", "baseless", "contradicted")
    v = verdict(F.col(verdict_col))
    worst = verdicts.groupBy(answer_key).agg(F.max(F.when(v == "contradicted", 2).when(v == "entailed", 0).otherwise(1)).alias("code"))
    return answers.select(answer_key).join(worst, answer_key, "left").select(answer_key, _pick(order, F.coalesce("code", F.lit(1))).alias("verdict"))


def kept_claims(claims: Column) -> Column:
    """The first ``MAX_CLAIMS`` non-blank claims of an ``array<string>``."""
    return F.slice(F.filter(claims, lambda c: c.rlike(r"(?U)\S")), 1, MAX_CLAIMS)


def _items(raw: Column | str) -> Column:
    """The items of a JSON list, fenced or not, as texts; [] for anything else."""
    return F.coalesce(F.from_json(unfenced(raw), "array<string>"), F.array().cast("array<string>"))


def _last_of(items: Column, index: Column) -> Column:
    """The last item whose ``claim_index`` reads as ``index``; null if none does."""
    own = F.filter(items, lambda x: F.get_json_object(x, "$.claim_index").try_cast("double").cast("int") == index)
    return F.try_element_at(own, F.lit(-1))


def _text(item: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(item, f"$.{name}"), F.lit(""))


def local_verdicts(claims: Column, raw: Column | str) -> Column:
    """``array<struct(verdicts, verdict, evidence, source_title)>``, one for each of ``claims``, from the first pass's answer.

    ``raw`` is a JSON list of ``{"claim_index", "window_verdicts", "evidence", "source_title"}``. Items without a usable
    index or beyond the claims are left out and the last of an index wins. A claim without an item, and one whose
    verdicts are no list or an empty one, has the one verdict baseless; unreadable JSON gives that to all. Missing
    texts are ''. ``verdict`` joins the windows'.
    """
    none = F.array(F.lit("baseless"))

    def record(item: Column) -> Column:
        given = F.from_json(F.get_json_object(item, "$.window_verdicts"), "array<string>")
        verdicts = F.when(F.size(given) > 0, F.transform(given, verdict)).otherwise(none)
        fields = F.struct(verdicts.alias("verdicts"), _text(item, "evidence").alias("evidence"), _text(item, "source_title").alias("source_title"))
        return F.transform(F.array(fields), lambda r: F.struct(r["verdicts"].alias("verdicts"), claim_verdict(r["verdicts"]).alias("verdict"), r["evidence"].alias("evidence"), r["source_title"].alias("source_title")))[0]

    per_row = lambda items: F.transform(claims, lambda _, i: F.transform(F.array(_last_of(items, i)), record)[0])
    return F.transform(F.array(_items(raw)), per_row)[0]


def unresolved(local: Column) -> Column:
    """Indices of the claims that the first pass didn't find entailed: those the second pass is asked about."""
    marked = F.transform(local, lambda r, i: F.when(r["verdict"] != "entailed", i))
    return F.array_compact(marked)


def final_verdicts(claims: Column, local: Column, raw: Column | str) -> Column:
    """``array<struct(claim, verdict, evidence, source_title)>`` after the second pass's answer ``raw``.

    ``raw`` is a JSON list of ``{"claim_index", "verdict", "evidence", "source_title"}``; the last item of an
    unresolved claim replaces its whole record, items of other claims count for nothing. A baseless claim carries no evidence.
    """

    def settled(claim: Column, first: Column, item: Column) -> Column:
        use = item.isNotNull() & (first["verdict"] != "entailed")
        v = F.when(use, verdict(F.get_json_object(item, "$.verdict"))).otherwise(first["verdict"])
        keep = lambda name: F.when(v == "baseless", "").when(use, _text(item, name)).otherwise(first[name])
        return F.struct(claim.alias("claim"), v.alias("verdict"), keep("evidence").alias("evidence"), keep("source_title").alias("source_title"))

    per_row = lambda items: F.transform(claims, lambda c, i: settled(c, F.get(local, i), _last_of(items, i)))
    return F.transform(F.array(_items(raw)), per_row)[0]


def with_global(local: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``local(keys, verdict, evidence, source_title)`` with the whole record of ``second`` where that has one for an unresolved claim.

    The same as ``final_verdicts`` for records that stand in tables. Claims already entailed keep their local record;
    baseless claims lose their evidence and source.
    """
    record = F.struct("verdict", "evidence", "source_title")
    rows = local.join(second.select(*keys, record.alias("g")), keys, "left")
    use = F.col("g").isNotNull() & (F.col("verdict") != "entailed")
    rows = rows.select(*keys, F.when(use, F.col("g")).otherwise(record).alias("r"))
    v = verdict(F.col("r.verdict"))
    return rows.select(*keys, v.alias("verdict"), *(F.when(v == "baseless", "").otherwise(F.col(f"r.{c}")).alias(c) for c in ("evidence", "source_title")))


def verifier(name: str):
    """``f(answer, contexts, gold) -> Column``, the verdict on an answer by the named verifier; ``ValueError`` for an unknown one."""
    if name == "lexical":
        return lambda answer, contexts, gold: lexical_verdict(F.coalesce(support(answer, contexts), F.lit(0.0)))
    if name == "oracle":
        return lambda answer, contexts, gold: col(gold)
    raise ValueError(f"no verifier {name!r}")


def judged_cases(cases: DataFrame, name: str, answer: str, contexts: Column, gold: str, keep: list[str]) -> DataFrame:
    """``(keep, gold, pred, correct)`` of every case."""
    pred = verifier(name)(answer, contexts, gold)
    return cases.select(*keep, F.col(gold).alias("gold"), pred.alias("pred")).withColumn("correct", F.col("gold").eqNullSafe(F.col("pred")))


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(gold, pred, n)`` for every pair of labels, zeros included; pairs outside the labels are left out."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
    counts = pairs.where(F.col("gold").isin(*labels) & F.col("pred").isin(*labels)).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(counts), ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per label, rounded to 4 digits, 0 where undefined; one aggregation."""
    sums = []
    for label in labels:
        gold, pred = F.col("gold") == label, F.col("pred") == label
        sums.append(F.struct(F.lit(label).alias("label"), F.count_if(gold & pred).alias("tp"), F.count_if(pred).alias("np"), F.count_if(gold).alias("ng")))
    rows = pairs.agg(F.array(*sums).alias("c")).select(F.inline("c"))
    p, r = F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "ng"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.col("ng").alias("support"))


def overall_metrics(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(accuracy, macro_f1, weighted_f1, n)``; averages use the rounded F1 of the labels, weights and accuracy all pairs."""
    per = class_metrics(pairs, labels)
    total = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("right"))
    rows = per.crossJoin(F.broadcast(total)).groupBy("n", "right").agg(F.avg("f1").alias("m"), F.sum(F.col("f1") * F.col("support")).alias("w"))
    return rows.select(
        F.round(F.coalesce(F.try_divide("right", "n"), F.lit(0.0)), 4).alias("accuracy"), F.round("m", 4).alias("macro_f1"),
        F.round(F.coalesce(F.try_divide("w", "n"), F.lit(0.0)), 4).alias("weighted_f1"), "n",
    )


def too_few(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Labels with fewer than ``least`` cases."""
    return pairs.groupBy("gold").agg(F.count("*").alias("n")).where(F.col("n") < least)
