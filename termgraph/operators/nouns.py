"""Language routing, compound nouns and class tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T


def routed(chunks: DataFrame, english_nouns: bool = True, text: str = "chunk_text") -> DataFrame:
    """Chunks with a text, each with its language and the channels that read it."""
    t = F.col(text)
    ko, en = T.has(t, T.HANGUL), T.has_latin_word(t)
    return chunks.where(~T.is_blank(text)).withColumns(
        {
            "lang": T.detect_lang(t),
            "ko_nouns": ko,
            "en_nouns": en & F.lit(english_nouns),
            "ko_relations": ko,
            "en_relations": ~ko & en,
            "skipped_en": (T.detect_lang(t) == "en") & F.lit(not english_nouns),
        }
    )


Test = Callable[[Column], Column]


def noun_runs(chunks: DataFrame, key: list[str], is_noun: Test, proper: Test, joiner: str, keep: Callable[[Column, Column, Column], Column], same: Test, tokens: str = "tokens") -> DataFrame:
    """Maximal runs of noun tokens that ``keep`` (surface, n, proper) accepts, the first of those whose ``same`` is equal in the chunk:
    (key, first, surface, n, proper).

    A run never leaves its chunk, so nothing is shuffled: the nouns are written as marks of one string, all else as a
    border, and the string is cut at the borders.  Only what is kept becomes a row."""
    end, border, sep = "\u0001", "\u0002", "\u0003"

    def mark(t: Column, i: Column) -> Column:
        word = F.concat(F.when(proper(t), "P").otherwise("C"), i.cast("string"), F.lit(sep), F.translate(t["form"], end + border + sep, "\ufffd" * 3))
        return F.when(F.coalesce(is_noun(t), F.lit(False)), word).otherwise(border)

    def run(r: Column) -> Column:
        parts = F.filter(F.split(r, end), lambda x: x != "")
        surface = F.array_join(F.transform(parts, lambda x: F.substring_index(x, sep, -1)), joiner)
        first = F.substr(F.substring_index(F.get(parts, F.lit(0)), sep, 1), F.lit(2)).cast("int")
        return F.struct(same(surface).alias("same"), first.alias("first"), surface.alias("surface"), F.size(parts).cast("long").alias("n"), F.exists(parts, lambda x: x.startswith("P")).alias("proper"))

    pieces = F.filter(F.split(F.array_join(F.transform(tokens, mark), end), border), lambda r: r.rlike("[PC]"))
    kept = F.filter(F.transform(pieces, run), lambda r: keep(r["surface"], r["n"], r["proper"]))
    ordered = chunks.select(*key, F.array_sort(kept).alias("_r"))
    one = F.filter("_r", lambda r, i: (i == 0) | (r["same"] != F.get("_r", i - 1)["same"]))
    return ordered.select(*key, F.explode(one).alias("r")).select(*key, "r.first", "r.surface", "r.n", "r.proper")


def korean_nouns(chunks: DataFrame, key: list[str], require_compound: bool = True, max_parts: int = 4, max_len: int = 20) -> DataFrame:
    """Compound nouns of each chunk: (key, first, surface, n, proper), the first of equal ones.

    A single common noun is dropped where a compound is required."""

    def keep(surface: Column, n: Column, proper: Column) -> Column:
        ok = T.full(surface, "[가-힣]{2,}") & ~surface.isin(*vocab.STOP_KO) & (n <= max_parts) & (F.length(surface) <= max_len)
        return ok & ((n > 1) | proper) if require_compound else ok

    return noun_runs(chunks, key, lambda t: t["tag"].isin("NNG", "NNP"), lambda t: t["tag"] == "NNP", "", keep, lambda s: s)


def last_noun(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, last): the last noun, compound or not, or an empty string."""
    last = korean_nouns(chunks, key, require_compound=False).groupBy(*key).agg(F.max_by("surface", "first").alias("last"))
    return chunks.select(*key).distinct().join(last, key, "left").select(*key, F.coalesce("last", F.lit("")).alias("last"))


def english_nouns(chunks: DataFrame, key: list[str], domain: tuple[str, ...] = (), require_compound: bool = True, max_words: int = 4, max_len: int = 40) -> DataFrame:
    """The same for English: runs of NN* tokens that are Latin throughout, joined by blanks, equal without case.

    A single common noun stays only where it is a word of the domain and not a stop word."""
    allowed = [d.lower() for d in domain if d.lower() not in vocab.STOP_EN]

    def keep(surface: Column, n: Column, proper: Column) -> Column:
        ok = (F.length(surface) >= 2) & (n <= max_words) & (F.length(surface) <= max_len)
        if require_compound:
            ok = ok & ((n > 1) | proper | (F.lower(surface).isin(*allowed) if allowed else F.lit(False)))
        return ok

    noun = lambda t: t["tag"].startswith("NN") & T.full(t["form"], "[A-Za-z][0-9A-Za-z.-]*")
    return noun_runs(chunks, key, noun, lambda t: t["tag"].isin("NNP", "NNPS"), " ", keep, F.lower)


def accumulate_classes(mentions: DataFrame, name: str = "name", chunk: str = "chunk_id", existing: DataFrame | None = None) -> DataFrame:
    """(name, source_chunks): every class with its chunks in order; a class without a chunk id has none."""
    rows = mentions.select(F.col(name).alias("name"), F.nullif(F.col(chunk), F.lit("")).alias("chunk"))
    if existing is not None:
        rows = rows.unionByName(existing.select("name", F.explode_outer("source_chunks").alias("chunk")))
    return rows.where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("chunk")).alias("source_chunks"))


def merge_classes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Class tables merged by name, chunks united."""
    return accumulate_classes(existing.select("name", F.explode_outer("source_chunks").alias("chunk_id")), existing=new)


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (first-wins merge)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
