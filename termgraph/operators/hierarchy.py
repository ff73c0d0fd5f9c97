"""subClassOf edges: shared suffixes and definitional sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T


def normalised_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(key, name): lower-cased names with single blanks; of the names of one key the smallest that qualifies."""
    n = names.select(F.col(name).alias("name")).withColumn("norm", T.squash("name")).withColumn("key", F.lower("norm"))
    spaced = F.contains("norm", F.lit(" "))
    fits = F.when(spaced, F.length("norm").between(2, 40) & ~F.col("key").isin(*vocab.STOP_EN)).otherwise(F.length("norm").between(2, 20) & ~F.col("norm").isin(*vocab.STOP_KO))
    return n.where(fits).groupBy("key").agg(F.min("name").alias("name"))


def suffixes(key: Column) -> Column:
    """Proper suffixes that may be a parent: of words where the name has blanks, else of two or more characters
    where it has Hangul; none for a single Latin word."""
    words = F.split(key, " ")
    by_word = F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    by_char = F.transform(F.sequence(F.lit(2), F.length(key) - 1), lambda i: key.substr(i, F.length(key)))
    none = F.array().cast("array<string>")
    return F.when(F.contains(key, F.lit(" ")), by_word).when(T.has(key, T.HANGUL) & (F.length(key) > 2), by_char).otherwise(none)


def tail_joins(tokens: Column) -> Column:
    """What the last 1, 2, ... tokens make together."""
    n = F.size(tokens)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.transform(F.slice(tokens, -k, k), lambda t: t["form"]), ""))).otherwise(F.array().cast("array<string>"))


def suffix_hierarchy(names: DataFrame, min_children: int = 2, tokens: DataFrame | None = None) -> DataFrame:
    """(parent, child) by shared suffix; a parent counts with ``min_children`` children or more.

    ``tokens`` (name, tokens) adds the morpheme tests: the parent must end at a morpheme border of the child, and
    its last morpheme mustn't be a proper noun."""
    known = normalised_names(names)
    child = known.select(F.col("key").alias("child_key"), F.col("name").alias("child"), F.explode(suffixes(F.col("key"))).alias("parent_key"))
    stop = vocab.STOP_EN | vocab.STOP_KO
    parent = known.select(F.col("key").alias("parent_key"), F.col("name").alias("parent"))
    spaced = F.contains("child_key", F.lit(" "))
    edges = child.join(parent, "parent_key").where(F.when(spaced, ~F.col("parent_key").isin(*vocab.STOP_EN)).otherwise(~F.col("parent_key").isin(*stop)))
    if tokens is not None:
        own = tokens.select(F.col("name").alias("child"), F.col("tokens").alias("child_tokens"))
        edges = edges.join(own, "child", "left").where(spaced | F.col("child_tokens").isNull() | F.array_contains(tail_joins(F.col("child_tokens")), F.col("parent")))
        top = tokens.select(F.col("name").alias("parent"), F.element_at("tokens", -1)["tag"].alias("last_tag"))
        edges = edges.join(top, "parent", "left")
    counted = edges.withColumn("children", F.count(F.lit(1)).over(Window.partitionBy("parent_key"))).where(F.col("children") >= min_children)
    if tokens is not None:
        counted = counted.where(F.coalesce(F.col("last_tag") != "NNP", F.lit(True)))
    return counted.where(F.col("child") != F.concat("parent", "parent")).select("parent", "child")


def standalone_noun(tokens: Column, name: Column) -> Column:
    """A noun that stands alone: two characters or more, not a bound ending, all tokens nominal, the last a noun."""
    nominal = F.forall(tokens, lambda t: t["tag"].isin(*vocab.NOMINAL))
    return (F.length(name) >= 2) & ~name.isin(*vocab.BOUND) & (F.size(tokens) > 0) & nominal & F.element_at(tokens, -1)["tag"].isin(*vocab.NOUNS)


def suffix_variants(tokens: Column, phrase: Column) -> Column:
    """The noun endings of a phrase from short to long, then the phrase."""
    nouns = F.transform(F.filter(tokens, lambda t: t["tag"].isin(*vocab.NOUNS)), lambda t: t["form"])
    n = F.size(nouns)
    ends = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(nouns, -k, k), ""))
    return F.when((n > 1) & T.has(phrase, T.HANGUL), F.concat(ends, F.array(phrase))).otherwise(F.array(phrase))


DEFINED = "[\"“]([A-Za-z가-힣]{2,20})[\"”]\\s*(?:은|는|이라고|이?란|이?라 함은)\\s+(.{5,80}?)[가를을이]?\\s*말한다"


def quoted_definitions(chunks: DataFrame, key: list[str], text: str = "chunk_text") -> DataFrame:
    """(key, child, body) of sentences like ``"X" is ... is called``; bodies that end in a bound noun are left out."""
    c = F.col(text)
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(DEFINED), F.lit(1)).alias("child"), F.regexp_extract_all(c, F.lit(DEFINED), F.lit(2)).alias("body"))
    rows = chunks.select(*key, F.explode(found).alias("f")).select(*key, "f.child", "f.body")
    return rows.where(~T.has(T.strip("body"), "(?:것|곳|등|때|바|수|자)\\s*\\z"))


def strip_parens(s: str) -> str:
    kept, open_ = "", 0
    for c in s:
        if c in "()":
            open_ = open_ + 1 if c == "(" else max(0, open_ - 1)
        else:
            kept += c * (not open_)
    return kept


class Token(tuple):
    """(form, tag, start, len)."""

    __slots__ = ()
    form = property(lambda s: s[0])
    tag = property(lambda s: s[1])
    start = property(lambda s: s[2])
    end = property(lambda s: s[2] + s[3])


def _ends_sentence(tokens: list[Token]) -> bool:
    tail = [(t.tag, t.form) for t in tokens[-3:]]
    return any(g in vocab.FINITE_TAGS and f[-1:] == "다" for g, f in tail) or "EF" in [g for g, _ in tail[-2:]]


def _subject(tokens: list[Token]) -> str:
    got: list[str] = []
    for t in tokens:
        if t.tag in vocab.NOUNS:
            got += [t.form]
        elif t.tag in vocab.TOPIC_TAGS or (t.tag not in vocab.FOREIGN_TAGS if got else t.tag == "JKG"):
            break
    return "".join(got)


def _run_before(tokens: list[Token], stop: int) -> str:
    first = stop
    while first and tokens[first - 1].tag in vocab.NOUNS:
        first -= 1
    cut = first < stop and first and tokens[first - 1].tag in ("SL", "SN")  # the phrase goes on to the left: a torn one
    return "" if cut else "".join(t.form for t in tokens[first:stop])


def _heads(tokens: list[Token]) -> list[str]:
    """Candidate parents of a defining sentence, the most precise pattern first."""
    found: list[tuple[int, str]] = []
    for i, t in enumerate(tokens):
        ahead = [x.form for x in tokens[i + 1 : i + 5]]
        if (t.form, t.tag) == ("의", "JKG"):
            if any(g in "".join(ahead) for g in vocab.GENUS):
                found.append((0, _run_before(tokens, i)))
        elif (t.form, t.tag) == ("에", "JKB") and "속하" in "".join(ahead[:2]):
            found.append((1, _run_before(tokens, i)))
        elif (t.form in vocab.SAYS and t.tag in {"VV", "NNG"}) or (t.form in vocab.NAMES and t.tag[:1] == "V"):
            j = i
            while j and tokens[j - 1].tag == "JKO":
                j -= 1
            found.append((2, _run_before(tokens, j)))
        elif (t.form, t.tag) == ("이", "VCP"):
            run = _run_before(tokens, i)
            if run not in vocab.NOT_A_PARENT:
                found.append((3, run))
    return [run for _, run in sorted(found, key=lambda f: f[0]) if run]


def defining_sentence(pieces: list[tuple[str, list[Token]]]) -> tuple[list[Token], str, str]:
    """(tokens, text, title) of the first of five pieces that ends a sentence; the title is the first one that doesn't."""
    title = ""
    for s, tokens in pieces[:5]:
        if not s.strip():
            continue
        if _ends_sentence(tokens):
            return tokens, strip_parens(s.strip()), title
        title = title or strip_parens(s.strip()).strip()
    return [], "", title


def pieces(text: Column) -> Column:
    """The first five pieces of a text that may be its defining sentence."""
    return F.slice(F.split(T.strip(text), "\\n|[!.?]\\s|(?<=다)\\.(?=[A-Za-z가-힣]|\\s)", -1), 1, 5)


def definitional_pairs(sentences: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """(key, child, parent) from ``sentences`` (key, pieces array<struct<text, tokens>>: the first pieces of each chunk, tokens
    of the text without its parentheses) and ``phrases`` (name, tokens), the readings of candidate names."""
    schema = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in key) + ", child string, phrase string, prio int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = [(p["text"], [Token((t["form"], t["tag"], t["start"], t["len"])) for t in p["tokens"]]) for p in row[-1]]
                tokens, text, title = defining_sentence(own)
                child = _subject(tokens)
                if not child or (title and child != title.replace(" ", "")) or not any("가" <= c <= "힣" for c in text):
                    continue
                rows += [(*row[:-1], child, run_, n) for n, run_ in enumerate(_heads(tokens))]
            yield pd.DataFrame(rows, columns=[*key, "child", "phrase", "prio"])

    found = sentences.select(*key, "pieces").mapInPandas(run, schema)
    read = phrases.select(F.col("name").alias("phrase"), F.col("tokens").alias("phrase_tokens"))
    wide = found.join(read, "phrase", "left").select(*key, "child", "prio", F.posexplode(F.when(F.col("phrase_tokens").isNull(), F.array("phrase")).otherwise(suffix_variants(F.col("phrase_tokens"), F.col("phrase")))).alias("nth", "parent"))
    own = phrases.select(F.col("name").alias("parent"), F.col("tokens").alias("parent_tokens"))
    good = wide.join(own, "parent").where((F.col("parent") != F.col("child")) & ~F.col("parent").isin(*vocab.NOT_A_PARENT) & standalone_noun(F.col("parent_tokens"), F.col("parent")))
    return good.groupBy(*key, "child", "parent").agg(F.min(F.struct("prio", "nth")).alias("rank"))


def merged_hierarchy(parts: list[DataFrame]) -> DataFrame:
    """(parent, child, src): the union of (parent, child) tables, the first source wins; no empty ends, no loops."""
    rows = None
    for i, p in enumerate(parts):
        own = p.select("parent", "child", F.lit(i).alias("src"))
        rows = own if rows is None else rows.unionByName(own)
    good = rows.where("parent IS NOT NULL AND child IS NOT NULL AND parent <> '' AND child <> '' AND parent <> child")
    return good.groupBy("parent", "child").agg(F.min("src").alias("src"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(child, parent, ppmi): positive pointwise mutual information of pattern pairs (child, parent, one row a find)."""
    n = pairs.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    a, b = n.groupBy("child").agg(F.sum("n").alias("nc")), n.groupBy("parent").agg(F.sum("n").alias("np"))
    joined = n.join(a, "child").join(b, "parent").crossJoin(F.broadcast(total))
    return joined.select("child", "parent", F.greatest(F.log(F.col("n") * F.col("total") / (F.col("nc") * F.col("np"))), F.lit(0.0)).alias("ppmi"))
