"""Relation triples: rule channels over tokens, pair classification with gates, and budgeted top-up."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from termgraph import vocab
from termgraph.functions import text as T
from termgraph.operators import svo
from termgraph.operators.hierarchy import Token
from termgraph.storage import materialise

MAX_PAIRS = 60
MIN_SCORE = 0.5
PLAN_ROWS = 500_000  #: candidates of one range of a call plan
TRIPLE = "subject string, predicate string, object string"


def _tokens(rows) -> list[Token]:
    return [Token((t["form"], t["tag"], t["start"], t["len"])) for t in rows]


def korean_triples(chunks: DataFrame, carry: bool = True, spaced: bool = False) -> DataFrame:
    """(chunk_id, ord, subject, predicate, object, inferred_subject) from (chunk_id, sentences array<struct<text, tokens>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cid, sents in zip(b["chunk_id"], b["sentences"]):
                found = svo.chunk_triples([(s["text"], _tokens(s["tokens"])) for s in sents], carry, spaced)
                out += [(cid, i, *t) for i, t in enumerate(found)]
            yield pd.DataFrame(out, columns=["chunk_id", "ord", "subject", "predicate", "object", "inferred_subject"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "sentences").mapInPandas(run, f"chunk_id {kind}, ord int, {TRIPLE}, inferred_subject boolean")


def tokenised_sentences(chunks: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, str, int, int]]]], text: str = "chunk_text") -> DataFrame:
    """(chunk_id, sentences) by a tokenizer that ``load`` makes once a worker: text -> [(form, tag, start, len)]; a text that it
    fails on has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = load()

        def tokens(s: str) -> list[dict]:
            try:
                return [dict(zip(("form", "tag", "start", "len"), t)) for t in tokenize(s)]
            except Exception:
                return []

        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "sentences": [[{"text": s, "tokens": tokens(s)} for s in svo.sentences(t or "")] for t in b["t"]]})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", F.col(text).alias("t")).mapInPandas(run, f"chunk_id {kind}, sentences array<struct<text:string,tokens:{vocab.TOKENS}>>")


def english_triples(parsed: DataFrame) -> DataFrame:
    """(chunk_id, ord, subject, predicate, object) from (chunk_id, nodes array<struct<i, head, text, lemma, pos, dep, ent_type>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, i, *t) for c, nodes in zip(b["chunk_id"], b["nodes"]) for i, t in enumerate(svo.english_triples([svo.Node(**dict(n)) for n in nodes]))]
            yield pd.DataFrame(out, columns=["chunk_id", "ord", "subject", "predicate", "object"])

    kind = parsed.schema["chunk_id"].dataType.simpleString()
    return parsed.select("chunk_id", "nodes").mapInPandas(run, f"chunk_id {kind}, ord int, {TRIPLE}")


SPLIT = "(?<=[!?])\\s|(?<=다)\\.(?=\\s)"


def split_sentences(text: Column | str) -> Column:
    return F.filter(F.split(T.lit_or_col(text), SPLIT, -1), lambda s: s.rlike("(?U)\\S"))


def entity_type(cls: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in vocab.ENTITY_TYPE.items() for x in kv])
    return F.coalesce(pairs[T.lit_or_col(cls)], F.lit("POH"))


def candidate_pairs(sentences: DataFrame, entities: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(chunk_id, sent, s, o, s_class, o_class, sentence) of entities that share a sentence, ``max_pairs`` a chunk.

    ``sentences`` is (chunk_id, sent, sentence); ``entities`` (chunk_id, ord, entity, class), of which the first of each surface counts.
    Subjects are persons and organisations."""
    one = entities.where("entity IS NOT NULL AND entity <> ''").groupBy("chunk_id", "entity").agg(F.min(F.struct("ord", F.coalesce("class", F.lit("")).alias("class"))).alias("f"))
    inside = sentences.join(one, "chunk_id").where(F.contains("sentence", F.col("entity"))).select("chunk_id", "sent", "sentence", "entity", F.col("f.ord").alias("ord"), F.col("f.class").alias("class"))
    both = inside.alias("x").join(inside.alias("y"), F.expr("x.chunk_id = y.chunk_id AND x.sent = y.sent AND x.ord <> y.ord")).where(entity_type("x.class").isin("PER", "ORG"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("sent", "i", "j"))
    flat = both.select(F.col("x.chunk_id").alias("chunk_id"), F.col("x.sent").alias("sent"), F.col("x.entity").alias("s"), F.col("y.entity").alias("o"), F.col("x.class").alias("s_class"), F.col("y.class").alias("o_class"), F.col("x.sentence").alias("sentence"), F.col("x.ord").alias("i"), F.col("y.ord").alias("j"))
    return flat.withColumn("nth", place).where(F.col("nth") <= max_pairs).drop("i", "j")


def marked(sentence: Column | str, s: Column | str, s_type: Column, o: Column | str, o_type: Column) -> Column:
    """The sentence with both entities marked at their first place; NULL where one is missing or they overlap."""
    t, s, o = T.lit_or_col(sentence), T.lit_or_col(s), T.lit_or_col(o)
    a, b = F.instr(t, s), F.instr(t, o)
    an, bn = F.length(s), F.length(o)

    def both(x: Column, xn: Column, xm: tuple[Column, str], y: Column, yn: Column, ym: tuple[Column, str]) -> Column:
        cut = lambda at, n: t.substr(at, n)
        return F.concat(cut(F.lit(1), x - 1), F.lit(" "), xm[0], F.lit(" "), cut(x, xn), F.lit(f" {xm[1]} "), cut(x + xn, y - x - xn), F.lit(" "), ym[0], F.lit(" "), cut(y, yn), F.lit(f" {ym[1]} "), cut(y + yn, F.length(t)))

    sm, om = (F.concat(F.lit("[S:"), s_type, F.lit("]")), "[/S]"), (F.concat(F.lit("[O:"), o_type, F.lit("]")), "[/O]")
    found = (a > 0) & (b > 0)
    return F.when(found & (a + an <= b), both(a, an, sm, b, bn, om)).when(found & (b + bn <= a), both(b, bn, om, a, an, sm))


def gate_reason(label: Column | str, s_class: Column | str, o_class: Column | str, obj: Column | str, sentence: Column | str) -> Column:
    """Why a relation is held back (S, T, O, G5), NULL where it isn't; only certain contradictions count."""
    label, s_class, o_class = T.lit_or_col(label), F.coalesce(T.lit_or_col(s_class), F.lit("")), F.coalesce(T.lit_or_col(o_class), F.lit(""))
    known = lambda c: c.isin(*vocab.KNOWN_CLASSES)
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])[label]
    allowed, cues = table(vocab.OBJECT_CLASSES), table(vocab.TRIGGERS)
    return (
        F.when(label.startswith("per:") & known(s_class) & (s_class != vocab.PERSON), "S")
        .when(label.startswith("org:") & known(s_class) & ~s_class.isin("기관", "지역"), "S")
        .when(T.full(T.strip(obj), vocab.RELATIVE_TIME), "T")
        .when(allowed.isNotNull() & known(o_class) & ~F.array_contains(allowed, o_class), "O")
        .when(cues.isNotNull() & ~F.exists(cues, lambda c: F.contains(T.lit_or_col(sentence), c)), "G5")
    )


def min_score(given: object = None, default: float = MIN_SCORE) -> float:
    """A threshold from an argument or a setting: finite and not negative, else the default."""
    try:
        x = float(given)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return x if 0 <= x < float("inf") else default


def classified(pairs: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], threshold: float = MIN_SCORE, batch: int = 32, max_chars: int = 720) -> DataFrame:
    """(chunk_id, subject, predicate, object, score): the labels that a model (made once a worker; texts -> (label, score)) gives the
    marked sentences of ``pairs``, without ``no_relation``, unsure and gated ones; the first of equal triples of a chunk."""
    ready = pairs.withColumn("marked", F.substring(marked("sentence", "s", entity_type("s_class"), "o", entity_type("o_class")), 1, max_chars)).where("marked IS NOT NULL")
    schema = StructType([*ready.schema.fields, StructField("label", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            got: list[tuple[str, float]] = []
            for at in range(0, len(b), batch):
                texts = list(b["marked"].iloc[at : at + batch])
                try:
                    found = model(texts)
                except Exception:
                    found = []
                got += found if len(found) == len(texts) else [("no_relation", 0.0)] * len(texts)
            yield b.assign(label=[g[0] for g in got], score=[float(g[1]) for g in got])

    named = F.when(F.col("label").startswith("LABEL_"), F.get(F.array(*map(F.lit, vocab.RELATIONS)), F.substring("label", 7, 9).try_cast("int"))).otherwise(F.col("label"))
    judged = ready.mapInPandas(run, schema).withColumn("label", named).where((F.col("label") != "no_relation") & (F.col("score") >= threshold))
    open_ = judged.where(gate_reason("label", "s_class", "o_class", "o", "sentence").isNull())
    first = open_.groupBy("chunk_id", F.col("s").alias("subject"), F.col("label").alias("predicate"), F.col("o").alias("object")).agg(F.min_by("score", "nth").alias("score"))
    return first.withColumn("score", F.round("score", 4))


def type_ok(label: Column | str, s_type: Column | str, o_type: Column | str) -> Column:
    """Whether the label's meaning allows the types; ``no_relation`` always."""
    label, s_type = T.lit_or_col(label), T.lit_or_col(s_type)
    allowed = F.create_map(*[x for k, v in vocab.OBJECT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])[label]
    subject = F.when(label.startswith("org:"), "ORG").otherwise("PER")
    return (label == "no_relation") | F.coalesce((s_type == subject) & F.array_contains(allowed, T.lit_or_col(o_type)), F.lit(False))


def best_allowed(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """``rows`` (id, s_type, o_type, logits in label order) -> (id, label): the best label that the types allow, the first of equals."""
    names = F.array(*map(F.lit, vocab.RELATIONS))
    long = rows.select("id", "s_type", "o_type", F.posexplode(logits).alias("n", "logit")).withColumn("label", F.get(names, F.col("n")))
    return long.where(type_ok("label", "s_type", "o_type")).groupBy("id").agg(F.max_by("label", F.struct("logit", -F.col("n"))).alias("label"))


def first_channel(a: Column | str, b: Column | str) -> Column:
    """The first channel's label unless it says 0, else the second's."""
    return F.coalesce(F.nullif(T.lit_or_col(a), F.lit(0)), T.lit_or_col(b))


# budgeted top-up


def topup_candidates(chunks: DataFrame, triples: DataFrame, when: str = "empty", chars_per_relation: int = 400) -> DataFrame:
    """``chunks`` (chunk_id, chunk_text) with ``relations`` that may be sent to the model: those without a triple, or with few."""
    if when not in ("empty", "sparse"):
        raise ValueError("when is 'empty' or 'sparse'")
    n = triples.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("relations"))
    j = chunks.join(n, "chunk_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    few = F.col("relations") == 0
    return j.where(few | (F.col("relations") < F.length("chunk_text") / max(chars_per_relation, 1)) if when == "sparse" else few)


def call_plan(candidates: DataFrame, total_chunks: int, max_pct: float | None = 0.10, max_usd: float | None = None, price_in: float = 0.005, price_out: float = 0.015, max_output: int = 1200, chars_per_token: float = 2.0, overhead: int = 400, margin_calls: float = 1.0, order: str = "chunk_id", chars: str | None = None) -> DataFrame:
    """``candidates`` with ``place`` (shortest text first) and ``called``: whether both caps leave room, with each call at its estimate.

    Estimates never fall along the order, so what is called is a prefix and a running sum decides.  The order is global, but no
    task holds it: the rows are written in ranges of about ``PLAN_ROWS``, a window goes over one range and starts with what the ranges before it
    hold.  ``chars``: a column that has the text's length already, so that the text needn't move."""
    est = lambda c: (c / chars_per_token + overhead) / 1000 * price_in + max_output / chars_per_token / 1000 * price_out
    length = F.col(chars) if chars else F.length("chunk_text")
    rows = materialise(candidates, "call-candidates")
    parts = max(1, -(-rows.count() // PLAN_ROWS))
    ranged = materialise(rows.repartitionByRange(parts, length, order).withColumns({"_range": F.spark_partition_id(), "_est": est(length)}), "call-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_est").alias("_sum"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_spent"))
    w = Window.partitionBy("_range").orderBy(length, order)
    upto = F.sum("_est").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumns({"place": F.row_number().over(w), "_upto": upto}).join(F.broadcast(starts), "_range").withColumn("place", (F.col("place") + F.col("_rows")).cast("int"))
    called = F.lit(True)
    if max_pct is not None:
        called = called & (F.col("place") <= int(total_chunks * max_pct))
    if max_usd is not None:
        worst = margin_calls * est(6000)
        called = called & (F.col("_spent") + F.col("_upto") + worst <= max_usd)
    return out.withColumn("called", called).drop("_range", "_est", "_upto", "_rows", "_spent")


def parsed_reply(raw: Column | str) -> Column:
    """Array of (s, p, o) in a reply: from its first brace to its last, the list ``triples``, entries with all three."""
    body = F.regexp_extract(F.coalesce(T.lit_or_col(raw), F.lit("")), "(?s)\\{.*\\}", 0)
    got = F.from_json(body, "triples array<struct<s:string,p:string,o:string>>")["triples"]
    full = lambda x: (F.coalesce(x["s"], F.lit("")) != "") & (F.coalesce(x["p"], F.lit("")) != "") & (F.coalesce(x["o"], F.lit("")) != "")
    return F.coalesce(F.filter(got, full), F.array().cast("array<struct<s:string,p:string,o:string>>"))


def _loose(c: Column) -> Column:
    return F.lower(T.unspaced(c))


def topped_up(rules: DataFrame, replies: DataFrame) -> DataFrame:
    """(chunk_id, subject, predicate, object, origin): the rule triples, and those of ``replies`` (chunk_id, raw) that are new to the
    chunk without regard to case and blanks; the first of equal new ones."""
    key = ["chunk_id", "_s", "_p", "_o"]
    keyed = lambda d: d.withColumns({"_s": _loose(F.col("subject")), "_p": _loose(F.col("predicate")), "_o": _loose(F.col("object"))})
    new = replies.select("chunk_id", F.posexplode(parsed_reply("raw")).alias("n", "t")).select("chunk_id", "n", F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"))
    fresh = keyed(new).join(keyed(rules).select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct("n", "subject", "predicate", "object")).alias("f"))
    return rules.select("chunk_id", "subject", "predicate", "object", F.lit("rules").alias("origin")).unionByName(fresh.select("chunk_id", "f.subject", "f.predicate", "f.object", F.lit("topup").alias("origin")))


class Budget:
    """Caps and spending of model calls that depend on each other (a driver-side loop over the candidates in order)."""

    def __init__(self, max_pct: float | None = 0.10, max_usd: float | None = None, price_in: float = 0.005, price_out: float = 0.015, max_output: int = 1200):
        self.max_pct, self.max_usd, self.price = max_pct, max_usd, (price_in, price_out)
        self.max_output, self.planned, self.called, self.spent = max_output, 0, 0, 0.0

    def plan(self, chunks: int) -> None:
        self.planned += chunks

    def estimate(self, chars: int, out: int | None = None) -> float:
        out = self.max_output if out is None else out
        return (chars / 2 + 400) / 1000 * self.price[0] + out / 2 / 1000 * self.price[1]

    def allows(self, chars: int) -> bool:
        if self.max_pct is not None and self.called >= int(self.planned * self.max_pct):
            return False
        return self.max_usd is None or self.spent + self.estimate(chars) + self.estimate(6000) <= self.max_usd

    def record(self, chars: int, out: int, usage: dict | None = None) -> None:
        tokens = (usage["input_tokens"], usage.get("output_tokens", 0)) if usage and "input_tokens" in usage else (chars / 3, out / 3)
        self.called += 1
        self.spent += sum(n / 1000 * p for n, p in zip(tokens, self.price))


def call_in_order(candidates: DataFrame, budget: Budget, total_chunks: int, call: Callable[[str], object], usage: Callable[[object], dict | None] | None = None, max_chars: int = 6000) -> DataFrame:
    """(chunk_id, raw): replies of ``call`` while the budget allows, shortest text first.  A call that fails costs and gives nothing.

    What may be called is bounded by the budget, so the driver takes the rows one partition at a time."""
    spark = candidates.sparkSession
    budget.plan(total_chunks)
    rows = []
    for r in candidates.orderBy(F.length("chunk_text"), "chunk_id").select("chunk_id", F.substring("chunk_text", 1, max_chars).alias("t"), F.length("chunk_text").alias("n")).toLocalIterator():
        if not budget.allows(r.n):
            break
        try:
            reply = call(r.t)
        except Exception:
            reply = ""
        raw = reply if isinstance(reply, str) else str(getattr(reply, "text", reply))
        budget.record(r.n, _out_chars(raw) or 100, usage(reply) if usage else None)
        rows.append((r.chunk_id, raw))
    kind = candidates.schema["chunk_id"].dataType.simpleString()
    return spark.createDataFrame(rows, f"chunk_id {kind}, raw string")


def _out_chars(raw: str) -> int:
    try:
        got = json.loads(raw[raw.index("{") : raw.rindex("}") + 1]).get("triples", [])
        return sum(len(str(t[k])) for t in got if all(t.get(x) for x in "spo") for k in "spo")
    except (ValueError, AttributeError, TypeError, KeyError):
        return 0


def hybrid_report(chunks: DataFrame, rules: DataFrame, plan: DataFrame, final: DataFrame) -> DataFrame:
    """One row of counts of a top-up."""
    n = lambda d, c, name: d.agg(F.count(F.when(c, 1)).alias(name))
    out = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    for part in (rules.agg(F.count_distinct("chunk_id").alias("rule_covered")), n(plan, F.lit(True), "topup_candidates"), n(plan, F.col("called"), "called"), n(rules, F.lit(True), "rule_triples"), n(final, F.col("origin") == "topup", "topup_triples")):
        out = out.crossJoin(part)
    return out.withColumns({"budget_skipped": F.col("topup_candidates") - F.col("called"), "call_pct": F.round(F.col("called") / F.greatest("total_chunks", F.lit(1)), 4)})
