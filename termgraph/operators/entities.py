"""Entity mentions: model output to records, spans against tokens and word borders, union of two models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T

MAX_CHARS = 1200
BATCH = 32
FIELDS = "word entity_group score start end".split()
RAW = "chunk_id string, word string, entity_group string, score double, start int, end int"


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], c)


def korean_records(raw: DataFrame, min_score: float = 0.40) -> DataFrame:
    """(chunk_id, entity, class, start, end, score) of model output: no subword marks, two characters or more, sure enough."""
    word, score = T.strip(F.replace(F.coalesce("word", F.lit("")), F.lit("##"), F.lit(""))), F.coalesce(F.col("score"), F.lit(1.0))
    group = F.coalesce(F.col("entity_group"), F.lit("ENTITY"))
    return raw.where((F.length(word) >= 2) & (score >= min_score)).select("chunk_id", word.alias("entity"), _mapped(group, vocab.NER_KO).alias("class"), "start", "end", F.round(score, 4).alias("score"))


def english_records(raw: DataFrame, emit_misc: bool = False, min_score: float = 0.0) -> DataFrame:
    """The same for English: no offsets, no MISC, surfaces with a letter."""
    word, score = T.strip(F.replace(F.coalesce("word", F.lit("")), F.lit("##"), F.lit(""))), F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(1.0))
    group = F.coalesce(F.col("entity_group"), F.lit("ENTITY"))
    ok = (F.length(word) >= 2) & T.has(word, T.LETTERS) & (score >= min_score)
    if not emit_misc:
        ok = ok & (group != "MISC")
    none = F.lit(None)
    return raw.where(ok).select("chunk_id", word.alias("entity"), _mapped(group, vocab.NER_EN).alias("class"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("double").alias("score"))


def inferred(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = BATCH, max_chars: int = MAX_CHARS, text: str = "chunk_text") -> DataFrame:
    """Model output for the first ``max_chars`` characters of each chunk.  ``load`` makes the model, once a worker; it takes a list of
    texts.  A batch that fails, or gives another number of results, is tried text by text; a text that fails gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = []
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    found = model(list(part["t"]))
                    if len(found) != len(part):
                        raise ValueError
                except Exception:
                    found = []
                    for t in part["t"]:
                        try:
                            found.append(model([t])[0])
                        except Exception:
                            found.append([])
                rows += [(c, *map(e.get, FIELDS)) for c, es in zip(part["chunk_id"], found) for e in es]
            out = pd.DataFrame(rows, columns=["chunk_id", *FIELDS])
            yield out.astype({"start": "Int32", "end": "Int32", "score": "float64"})

    return chunks.select("chunk_id", F.substring(text, 1, max_chars).alias("t")).where(~T.is_blank("t")).mapInPandas(run, RAW)


def two_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of the first part of each chunk, and those of the next part whose surface is new there, without offsets."""
    none = F.lit(None).cast("int")
    return first.unionByName(second.join(first.select("chunk_id", "entity").distinct(), ["chunk_id", "entity"], "left_anti").withColumns({"start": none, "end": none}).select(*first.columns))


def aux_ok(entity: Column | str, cls: Column | str, clean: Column | None = None) -> Column:
    """Whether a record of the auxiliary model may be added; ``clean`` is ``label_ok`` where there are tokens."""
    w = T.strip(F.coalesce(T.lit_or_col(entity), F.lit("")))
    first = F.get(F.split(T.squash(w), " "), F.lit(0))
    bad = (
        (w == "")
        | T.has(w, "(?U)\\A[\\W_]|[\\W_]\\z")
        | T.full(first, "[a-z][A-Za-z]*")
        | T.full(w, "[A-Za-z]{1,2}")
        | T.has(w, "(?U)\\A\\d+(?:\\s*(?:nd|rd|st|th)\\b|\\s+[a-z])")
        | T.full(w, "[A-Z]{2,}s")
        | ~T.has(w, T.HANGUL)
        | T.full(w, "[0-9]{1,2}년")
        | (w.endswith("어") & F.coalesce(T.lit_or_col(cls) == "기관", F.lit(False)))
    )
    return ~bad & (F.coalesce(clean, F.lit(True)) if clean is not None else F.lit(True))


def united(base: DataFrame, aux: DataFrame, clean: Column | None = None) -> DataFrame:
    """``base`` and the records of ``aux`` that pass and whose surface is new in the chunk, the first of equal ones (column ``ord``)."""
    key = lambda d: d.withColumn("_k", T.unspaced(F.coalesce("entity", F.lit(""))))
    new = key(aux).where((F.col("_k") != "") & aux_ok("entity", "class", clean)).join(key(base).select("chunk_id", "_k").distinct(), ["chunk_id", "_k"], "left_anti")
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id", "_k").orderBy("ord"))).where("_n = 1").withColumn("entity", T.strip("entity"))
    return base.unionByName(one.select(*base.columns))


def aligned(records: DataFrame, text: str = "chunk_text", tokens: str = "tokens") -> DataFrame:
    """Records (entity, start, end beside the chunk's text and tokens) whose end is inside a token, extended to its end.

    Only the first such token counts; it mustn't begin after the span nor be over eight characters longer, and the new
    surface must be longer than the old."""
    hit = F.filter(tokens, lambda t: (t["start"] < F.col("end")) & (F.col("end") < t["start"] + F.length(t["form"])) & (F.col("start") >= t["start"]) & (F.length(t["form"]) <= F.col("end") - F.col("start") + 8))
    one = F.get(hit, F.lit(0))
    stop = one["start"] + F.length(one["form"])
    wide = T.strip(F.col(text).substr(F.col("start") + 1, stop - F.col("start")))
    longer = F.coalesce((wide != "") & (F.length(wide) > F.length("entity")), F.lit(False))
    return records.withColumn("_wide", F.when(longer, F.struct(wide.alias("e"), stop.alias("s")))).withColumns({"entity": F.coalesce("_wide.e", "entity"), "end": F.coalesce("_wide.s", "end")}).drop("_wide")


def border_ok(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Whether a span begins and ends at word borders: after it only particles may follow in the same word (once the plural
    before them), units after a number; a span without offsets, or outside the text, passes."""
    text, start, end = T.lit_or_col(text), T.lit_or_col(start), T.lit_or_col(end)
    left = text.substr(start, F.lit(1))
    nxt = text.substr(end + 1, F.lit(1))
    run = F.regexp_extract(F.substr(text, end + 1), "\\A[가-힣]+", 0)
    numeric = T.full(text.substr(start + 1, end - start), "[0-9][0-9.,\\s]*")
    particles = T.greedy_units(sorted(vocab.PARTICLES))
    plural = run.startswith(vocab.PLURAL) & F.substr(run, F.lit(2)).rlike(particles)
    right = F.when(nxt.rlike(T.HANGUL), numeric | plural | run.rlike(particles)).when(nxt.rlike("[0-9A-Za-z]"), numeric & ~nxt.rlike("[0-9]")).otherwise(True)
    placed = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.when(~F.coalesce(placed, F.lit(False)), True).when((start > 0) & left.rlike("[가-힣0-9A-Za-z]"), False).when(end >= F.length(text), True).otherwise(right)


def label_ok(label: Column | str, tokens: Column | str | None = None) -> Column:
    """Label hygiene: two characters, no word that begins like its neighbour, and, where there is a reading, no ending or
    particle at its edges and something of content inside."""
    c = F.coalesce(T.lit_or_col(label), F.lit(""))
    words = F.split(T.squash(c), " ")
    n = F.size(words)
    pair = lambda i: (F.get(words, i).startswith(F.get(words, i + 1))) | (F.get(words, i + 1).startswith(F.get(words, i)))
    repeat = F.when(n > 1, F.exists(F.sequence(F.lit(0), n - 2), pair)).otherwise(False)
    ok = (F.length(F.replace(c, F.lit(" "), F.lit(""))) >= 2) & ~repeat
    if tokens is None:
        return ok
    t = T.lit_or_col(tokens)
    tag = lambda i: F.element_at(t, i)["tag"]
    read = (F.size(t) > 0) & ~tag(1).rlike("\\A(?:J|E|XS|VC[PN])") & ~tag(-1).rlike("\\A(?:J|E|VC[PN])") & F.exists(t, lambda x: x["tag"].rlike("\\A(?:N|SL|SN|SH|XR)"))
    return ok & (t.isNull() | F.coalesce(read, F.lit(False)))
