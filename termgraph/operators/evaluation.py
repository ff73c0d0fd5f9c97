"""Scores of graphs and classifiers, and the preparation of labelled rows."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph.functions import text as T


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def _prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn."""
    d = df.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _n(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)


def micro_f1(rows: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 without class 0; a wrong label counts on both sides."""
    g, p = F.col(gold), F.col(pred)
    agg = [_n((p != 0) & (p == g), "tp"), _n((p != 0) & (p != g), "fp"), _n((g != 0) & (p != g), "fn")]
    return _prf(rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg))


def per_class(rows: DataFrame, top: int = 15, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, support, tp, fp, precision, recall, f1) of the ``top`` classes by support."""
    g = rows.where(F.col(gold) != 0).select(F.col(gold).alias("label"), F.lit(1).alias("support"), F.when(F.col(pred) == F.col(gold), 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"))
    p = rows.where((F.col(pred) != 0) & (F.col(pred) != F.col(gold))).select(F.col(pred).alias("label"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.lit(1).alias("fp"))
    c = g.unionByName(p).groupBy("label").agg(*[F.sum(x).cast("long").alias(x) for x in ("support", "tp", "fp")])
    d = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("support"))).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return d.select("label", "support", "tp", "fp", *[F.round(x, 3).alias(x) for x in ("precision", "recall", "f1")]).orderBy(F.desc("support"), "label").limit(top)


def type_prior(train: DataFrame, rows: DataFrame, keys: list[str], label: str = "label", order: str = "ord") -> DataFrame:
    """``rows`` with ``pred``: the most frequent label of the same keys in ``train`` (ties: first seen), 0 for unseen keys."""
    n = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = n.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("pred"))
    return rows.join(best, keys, "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def connected_share(gold: DataFrame, triples: DataFrame) -> DataFrame:
    """One row (hit, total): gold pairs (id, s, o, label <> 0) that some triple of the same id links, in either direction, by containment."""
    like = lambda a, b: F.contains(a, F.col(b)) | F.contains(b, F.col(a))
    t = triples.select(F.col("id").alias("_id"), F.col("subject").alias("_s"), F.col("object").alias("_o"))
    g = gold.where("label <> 0")
    hit = g.join(t, (F.col("id") == F.col("_id")) & ((like("s", "_s") & like("o", "_o")) | (like("s", "_o") & like("o", "_s"))), "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("hit")).crossJoin(g.agg(F.count(F.lit(1)).alias("total")))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pair_prf(positives: DataFrame, negatives: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over unordered pairs (a, b), each once."""
    p = _pairs(predicted).withColumn("hit", F.lit(True))
    rows = _pairs(positives).withColumn("pos", F.lit(True)).unionByName(_pairs(negatives).withColumn("pos", F.lit(False))).join(p, ["a", "b"], "left")
    hit = F.col("hit").isNotNull()
    return _prf(rows.agg(_n(F.col("pos") & hit, "tp"), _n(~F.col("pos") & hit, "fp"), _n(F.col("pos") & ~hit, "fn")))


def net_value(positives: DataFrame, baseline: str = "baseline", system: str = "system") -> DataFrame:
    """One row (residual, recall): of the positives that the baseline misses, the share that the system finds."""
    rest = positives.where(~F.col(baseline))
    return rest.agg(F.count(F.lit(1)).alias("residual"), F.coalesce(F.avg(F.col(system).cast("double")), F.lit(0.0)).alias("recall"))


def auc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row (auc, n_pos, n_neg): the chance that a positive scores above a negative, ties half; 0 if a side is empty.

    From rank sums of the distinct scores, so only one row a score is ordered."""
    per = rows.groupBy(score).agg(_n(F.col(positive), "p"), _n(~F.col(positive), "n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = per.withColumn("wins", F.col("p") * (before + F.col("n") / 2)).agg(F.coalesce(F.sum("wins"), F.lit(0.0)).alias("wins"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"))
    return s.select(_ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def threshold_sweep(rows: DataFrame, thresholds: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) for each threshold."""
    hit = F.col(score) >= F.col("threshold")
    return _prf(rows.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(_n(F.col(positive) & hit, "tp"), _n(~F.col(positive) & hit, "fp"), _n(F.col(positive) & ~hit, "fn")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the best F1, the least threshold of equals."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def ranking_scores(queries: DataFrame, predictions: DataFrame, gold: DataFrame, top: int = 15, gold_divisor: bool = False) -> DataFrame:
    """One row (p1, mrr, map, n) over ``queries`` (q): ``predictions`` (q, rank, term), ``gold`` (q, term), equal without blanks.

    Average precision is divided by the smaller of gold and prediction counts, or by the gold count with ``gold_divisor``."""
    key = lambda d, *more: d.select("q", F.replace("term", F.lit(" "), F.lit("")).alias("t"), *more)
    g = key(gold).distinct()
    p = key(predictions, "rank").where(F.col("rank") <= top).join(g.withColumn("hit", F.lit(1)), ["q", "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    run = p.withColumn("got", F.sum("hit").over(Window.partitionBy("q").orderBy("rank")))
    per = run.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).alias("p1"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.col("hit") * F.col("got") / F.col("rank")).alias("ap"), F.count(F.lit(1)).alias("preds"))
    size = g.groupBy("q").agg(F.count(F.lit(1)).alias("golds"))
    j = queries.select("q").distinct().join(per, "q", "left").join(size, "q", "left")
    div = F.greatest(F.coalesce("golds", F.lit(0)), F.lit(1))
    ap = F.col("ap") / (div if gold_divisor else F.least(div, F.col("preds")))
    z = lambda c, n: F.avg(F.coalesce(c, F.lit(0.0))).alias(n)
    return j.agg(z(F.col("p1").cast("double"), "p1"), z(F.col("rr"), "mrr"), z(ap, "map"), F.count(F.lit(1)).alias("n"))


def hierarchy_scores(predicted: DataFrame, direct: DataFrame, closed: DataFrame) -> DataFrame:
    """One row (pred, tp, precision, recall_direct, f1, hetero_f1): predicted (child, parent) against the closure (precision) and
    the direct pairs (recall); hetero: pairs whose child doesn't end with the parent."""
    d = lambda x: x.select("child", "parent").distinct()
    p, g, c = d(predicted), d(direct), d(closed)
    other = ~(F.col("child").endswith(F.col("parent")) & (F.col("child") != F.col("parent")))
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    row = n(p, "pred")
    for part in (n(p.intersect(c), "tp"), n(g, "gold"), n(p.intersect(g), "direct_tp"), n(p.intersect(c).where(other), "hetero_pred"), n(g.where(other), "hetero_gold"), n(p.intersect(g).where(other), "hetero_tp")):
        row = row.crossJoin(part)
    r = row.withColumns({"precision": _ratio(F.col("tp"), F.col("pred")), "recall_direct": _ratio(F.col("direct_tp"), F.col("gold")), "_hp": _ratio(F.col("hetero_tp"), F.col("hetero_pred")), "_hr": _ratio(F.col("hetero_tp"), F.col("hetero_gold"))})
    return r.select("pred", "tp", "precision", "recall_direct", _ratio(2 * F.col("precision") * F.col("recall_direct"), F.col("precision") + F.col("recall_direct")).alias("f1"), _ratio(2 * F.col("_hp") * F.col("_hr"), F.col("_hp") + F.col("_hr")).alias("hetero_f1"))


def substring_oracle(leads: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (hit, n): leads (q, text) that contain a gold term."""
    j = leads.join(gold.select("q", "term"), "q", "left").groupBy("q").agg(F.max(F.coalesce(F.contains("text", F.col("term")), F.lit(False))).alias("hit"))
    return j.agg(_n(F.col("hit"), "hit"), F.count(F.lit(1)).alias("n"))


def confidence_report(rows: DataFrame, block: str, threshold: float = 0.5) -> DataFrame:
    """(block, n, tp, fp, fn, precision, recall, f1, coverage, median) of each block, on rows (gold, pred, conf) at ``threshold`` or above."""
    r = rows.withColumn("kept", F.col("conf") >= threshold).withColumn("p", F.when(F.col("kept"), F.col("pred")).otherwise(0))
    g, p = F.col("gold"), F.col("p")
    a = r.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n"), _n((p != 0) & (p == g), "tp"), _n((p != 0) & (p != g), "fp"), _n((g != 0) & (p != g), "fn"), F.avg(F.col("kept").cast("double")).alias("coverage"), F.percentile("conf", 0.5).alias("median"))
    return _prf(a)


def histogram(rows: DataFrame, value: str = "conf", width: float = 0.05) -> DataFrame:
    """(bin, n) of a score in steps of ``width``."""
    return rows.groupBy(F.floor(F.col(value) / F.lit(width) + F.lit(1e-9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def surface_kind(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``kind``: ``surface`` where only separators and case differ, else ``semantic``."""
    k = lambda c: F.lower(T.surface_key(c))
    return pairs.withColumn("kind", F.when(k("a") == k("b"), "surface").otherwise("semantic"))


def positives(names: DataFrame) -> DataFrame:
    """(name, canonical): the distinct pairs of a name and another canonical name."""
    return names.where("name <> canonical").select("name", "canonical").distinct()


def hard_negatives(names: DataFrame, cap: int, prefix: int = 2) -> DataFrame:
    """(a, b): names (name, canonical) with the same beginning but another canonical name, at most ``cap``, in order."""
    n = names.select("name", "canonical", F.lower(T.surface_key("name")).substr(1, prefix).alias("pre")).distinct()
    j = n.alias("x").join(n.alias("y"), F.expr("x.pre = y.pre AND x.name < y.name AND x.canonical <> y.canonical"))
    return j.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).orderBy("a", "b").limit(cap)


def held_out(rows: DataFrame, order: list[str], every: int = 4) -> DataFrame:
    """``rows`` with ``split``: every fourth of the order, from the first, is dev."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("split", F.when(place % every == 0, "dev").otherwise("test"))


def cap_per_label(rows: DataFrame, cap: int, order: list[Column | str], label: str = "label") -> DataFrame:
    """The first ``cap`` rows of each label."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def located(rows: DataFrame, sentence: str = "sentence", words: tuple[str, str] = ("s", "o")) -> DataFrame:
    """``rows`` with the first and last place (from 0) of both words; rows that lack one go."""
    out = rows
    for w in words:
        at = F.instr(F.col(sentence), F.col(w))
        out = out.withColumns({f"{w}_start": at - 1, f"{w}_end": at + F.length(w) - 2})
    return out.where(" AND ".join(f"{w}_start >= 0" for w in words))


def relabelled(rows: DataFrame, min_conf: float = 0.9) -> DataFrame:
    """Teacher rows (label, conf) that are kept: a relation, sure enough."""
    return rows.where((F.col("label") != "no_relation") & (F.col("conf") >= min_conf))


def distant_rows(facts: DataFrame, mapping: DataFrame, max_distance: int = 280, window: int = 320) -> DataFrame:
    """Facts (text, property, s_start, s_end, s_type, o_start, o_end, evidence) -> (label, sentence, s_start, o_start, ...): mapped by
    ``mapping`` (property, label, s_type, cue), both within ``max_distance``, cut to a window of ``window`` characters around them."""
    m = mapping.withColumnRenamed("s_type", "m_type")
    j = facts.join(F.broadcast(m), "property").where((F.col("s_type") == F.col("m_type")) & (F.abs(F.col("s_start") - F.col("o_start")) <= max_distance))
    low, high = F.least("s_start", "o_start"), F.greatest("s_end", "o_end")
    left = F.greatest(low - F.floor((F.lit(window) - (high - low)) / 2).cast("int"), F.lit(0))
    out = j.withColumn("_left", left).withColumn("sentence", F.col("text").substr(F.col("_left") + 1, F.lit(window)))
    ok = F.col("cue").isNull() | F.contains("sentence", F.col("cue"))
    return out.where(ok).select("label", "sentence", *[(F.col(c) - F.col("_left")).alias(c) for c in ("s_start", "s_end", "o_start", "o_end")])


def replicated(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k")


def capped_counts(counts: dict[str, int], share: float) -> dict[str, int]:
    """What is left of each count when all that hold more than ``share`` of the sum lose one, again and again until none does.

    Rounds in which the same ones lose are taken at once, so the steps grow with the number of names, not with the counts."""
    counts, part = dict(counts), Fraction(share).limit_denominator(10**6)
    while counts and len(counts) * part >= 1:
        total = sum(counts.values())
        over = [t for t, n in counts.items() if n > part * total]
        if not over:
            break
        m = len(over)
        # after j rounds the sum is total - m*j: one stops when n - j <= part*sum, one starts when n > part*sum
        ends = [math.ceil((n - part * total) / (1 - part * m)) for t, n in counts.items() if t in over] if part * m < 1 else []
        starts = [math.floor((total - n / part) / m) + 1 for t, n in counts.items() if t not in over and n]
        rounds = max(1, min([*ends, *starts, min(counts[t] for t in over)]))
        for t in over:
            counts[t] -= rounds
    return counts


def trigger_share_cap(rows: DataFrame, share: float = 0.4, trigger: str = "trigger", score: str = "score") -> DataFrame:
    """``rows`` without the worst of triggers that hold more than ``share`` of what is left (``capped_counts``); equal scores in the order of all columns' hash.

    Only the counts by trigger (a closed vocabulary) come to the driver."""
    counts = capped_counts({r[trigger]: r.n for r in rows.groupBy(trigger).agg(F.count(F.lit(1)).alias("n")).collect()}, share)
    if not counts:
        return rows
    keep = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    order = Window.partitionBy(trigger).orderBy(F.desc(score), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep[F.col(trigger)]).drop("_n")
