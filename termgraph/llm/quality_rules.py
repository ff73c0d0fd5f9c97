"""Quality rules judged with the record of the document's host.

Each rule has a soft and a hard limit.  Rule failures are added up by host
(a narrow aggregate); a host's rate of each rule is shrunk towards the corpus by
a beta prior fitted to the hosts' rates (method of moments), so that a host with
three documents isn't condemned by two of them.  A document is rejected when it
passes a hard limit, or when it passes a soft limit of a rule whose shrunk rate at
its host is above ``host_limit``.  A document that passes no limit is never rejected.

Words are runs between blanks; a word counts as having letters by Unicode class, whatever its script.  Scripts that don't part
words (Han, kana, Thai, Lao, Tibetan, Burmese, Khmer): words with such characters are left out where word length is judged, and each such
character counts as a word where symbols are compared with words.

All of it is JVM-side.  A text is measured once: its two bit masks are written with the row, the host table comes of the masks
alone, and its bytes are checked before it is broadcast; a larger one is joined by a shuffle that salts hosts with many rows.

Defined cases: ids and hosts of any type (ids play no part); a NULL text fails ``no_text`` and is rejected; an empty or blank one
likewise; a NULL host counts as a host of its own; repeated rows are judged one by
one; an empty table gives an empty table; other columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgraph.llm.lookup import BROADCAST_BYTES, lookup
from termgraph.storage import fresh_name, materialise

SYMBOLS = "#$%&*|~^{}<>"
RULES = ("symbols", "upper", "repeats", "nonalpha", "lines", "length")
HOST_LIMIT = 0.5
_WORD = "[^ \\t\\r\\n]+"
#: scripts that don't part words by blanks
_UNSPACED = "\\u0E00-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u31F0-\\u31FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uFF66-\\uFF9F\\x{20000}-\\x{3FFFF}"


def measures(text: Column) -> dict[str, Column]:
    """Counts that the rules compare; every one is a built-in expression."""
    parts = F.split(text, "[ \\t\\r\\n]+", -1)
    lines = F.split(text, "\n", -1)
    words = F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    # from a word's start, without going back: linear on any word
    spaced = F.regexp_replace(text, f"(?<![^ \\t\\r\\n])[^ \\t\\r\\n{_UNSPACED}]*+[{_UNSPACED}][^ \\t\\r\\n]*+[ \\t\\r\\n]*+", "")
    other = F.struct((words + F.regexp_count(text, F.lit(f"[{_UNSPACED}]"))).alias("units"), F.length(spaced).alias("spaced_chars"), F.regexp_count(spaced, F.lit(_WORD)).alias("spaced_words"))
    return {
        "chars": F.length(text),
        "words": words,
        "symbols": F.regexp_count(text, F.lit("[" + "".join("\\" + s for s in SYMBOLS) + "]")),
        "upper": F.regexp_count(text, F.lit("\\p{Lu}")),
        # words less those without a letter; that pattern begins at a word's start and never goes back, so that it is linear on any word
        "alpha": words - F.regexp_count(text, F.lit("(?<![^ \\t\\r\\n])[^ \\t\\r\\n\\p{L}]++(?![^ \\t\\r\\n])")),
        "kinds": F.size(F.array_distinct(parts)),
        "lines": F.size(lines),
        "line_kinds": F.size(F.array_distinct(lines)),
        # NULL, after one scan, for a text that can't have such a script
        "other": F.when((F.octet_length(text) > F.length(text)) & F.regexp_like(text, F.lit("[\\u0E00-\\x{3FFFF}]")), other),
    }


#: rule -> (soft, hard): conditions over the measures
LIMITS = {
    "symbols": ("symbols * 10 > words", "symbols * 10 > words * 3"),
    "upper": ("upper * 4 > chars AND words >= 5", "upper * 5 > chars * 2 AND words >= 5"),
    "repeats": ("kinds * 10 < words * 3 AND words >= 20", "kinds * 5 < words AND words >= 20"),
    "nonalpha": ("(words - alpha) * 4 > words AND words >= 5", "(words - alpha) * 5 > words * 2 AND words >= 5"),
    "lines": ("(lines - line_kinds) * 10 > lines * 3 AND lines >= 4", "(lines - line_kinds) * 2 > lines AND lines >= 4"),
    "length": ("(chars > words * 12 OR chars < words * 3) AND words >= 10", "(chars > words * 20 OR chars * 2 < words * 5) AND words >= 10"),
}

#: measures that a rule's limits mean; they differ from those named only in texts with unspaced scripts, which the SQL check's tables lack
MEANT = {"symbols": {"words": "units"}, "length": {"chars": "spaced_chars", "words": "spaced_words"}}


def flags(docs: DataFrame, text: str, soft: str, hard: str) -> DataFrame:
    """``docs`` with two bit masks: bit i is rule i of RULES, the next one ``no_text``."""
    filled = F.length(F.trim(F.regexp_replace(F.substring(text, 1, 1 << 30), "[\\t\\r\\n]", " "))) > 0
    own = {k: fresh_name(docs, f"m_{k}") for k in ("chars", "words", "symbols", "upper", "alpha", "kinds", "lines", "line_kinds", "other")}
    has = fresh_name(docs, "m_filled")
    # columns of their own: each is measured once, however many limits read it
    out = docs.withColumns({has: F.coalesce(filled, F.lit(False)), **{own[k]: c for k, c in measures(F.col(text)).items()}})

    def mask(which: int) -> Column:
        bits = F.lit(0)
        for i, rule in enumerate(RULES):
            cond = LIMITS[rule][which]
            for k in ("line_kinds", "symbols", "upper", "kinds", "alpha", "words", "chars", "lines"):
                meant = MEANT.get(rule, {}).get(k)
                cond = _field(cond, k, f"coalesce(`{own['other']}`.{meant},`{own[k]}`)" if meant else f"`{own[k]}`")
            bits = bits + F.when(F.expr(cond), 1 << i).otherwise(0)
        return F.when(~F.col(has), F.lit(1 << len(RULES))).otherwise(bits)

    return out.withColumns({soft: mask(0), hard: mask(1)}).drop(has, *own.values())


def _field(condition: str, name: str, field: str) -> str:
    return " ".join(field if w == name else w for w in condition.replace("(", " ( ").replace(")", " ) ").split())


def host_rates(flagged: DataFrame, host: str, soft: str) -> DataFrame:
    """(host, host_docs, rate_<rule>...): failure rates of each host, shrunk by an empirical beta prior."""
    counts = flagged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.shiftright(F.col(soft), i).bitwiseAND(1)).alias(f"f_{r}") for i, r in enumerate(RULES)]
    )
    raw = {r: F.col(f"f_{r}") / F.col("host_docs") for r in RULES}
    prior = counts.agg(*[F.avg(raw[r]).alias(f"m_{r}") for r in RULES], *[F.var_pop(raw[r]).alias(f"v_{r}") for r in RULES])
    shrunk = []
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(1e6))
        shrunk.append(F.round((m * weight + F.col(f"f_{r}")) / (weight + F.col("host_docs")), 6).alias(f"rate_{r}"))
    return counts.crossJoin(F.broadcast(prior)).select("host", "host_docs", *shrunk)


def _names(docs: DataFrame) -> dict[str, str]:
    return {n: fresh_name(docs, n) for n in ("soft", "hard", "host_docs", "host_bad", "keep")}


def _verdicts(flagged: DataFrame, names: dict[str, str], host: str, host_limit: float, broadcast_bytes: int, only_bad: bool) -> DataFrame:
    """Rows with masks (a written table) -> the same with ``host_docs``, ``host_bad`` and ``keep``; with ``only_bad`` host_docs is NULL at
    hosts without a bad rule, which aren't looked up."""
    rates = host_rates(flagged, host, names["soft"])
    bad = F.lit(0)
    for i, r in enumerate(RULES):
        bad = bad + F.when(F.col(f"rate_{r}") > host_limit, 1 << i).otherwise(0)
    none, key, place = (fresh_name(flagged, n) for n in ("host_none", "host_key", "host_spread"))
    keys = {none: F.col("host").isNull(), key: F.coalesce(F.col("host").cast("string"), F.lit(""))}
    hosts = materialise(rates.select("host_docs", bad.alias("bad"), *[c.alias(k) for k, c in keys.items()]), "hosts")
    table = hosts.select(none, key, F.col("host_docs").alias(names["host_docs"]), F.col("bad").alias(names["host_bad"]))
    rows = flagged.withColumns({none: F.col(host).isNull(), key: F.coalesce(F.col(host).cast("string"), F.lit("")), place: F.monotonically_increasing_id()})
    out = lookup(rows, table.where(F.col(names["host_bad"]) != 0) if only_bad else table, hosts.select(none, key, F.col("host_docs").alias("n")), [none, key], place, "left", broadcast_bytes)
    out = out.withColumn(names["host_bad"], F.coalesce(F.col(names["host_bad"]), F.lit(0)))
    condemned = (F.col(names["hard"]) != 0) | (F.col(names["soft"]).bitwiseAND(F.col(names["host_bad"])) != 0)
    return out.withColumn(names["keep"], ~condemned).select(*flagged.columns, names["host_docs"], names["host_bad"], names["keep"])


def judged(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, broadcast_bytes: int = BROADCAST_BYTES, with_text: bool = True) -> DataFrame:
    """``docs`` (without the text, if not ``with_text``) with ``soft``, ``hard``, ``host_docs``, ``host_bad`` (bit masks of rules) and ``keep``.

    Names that ``docs`` has already get leading underscores."""
    names = _names(docs)
    flagged = flags(docs, text, names["soft"], names["hard"])
    return _verdicts(materialise(flagged if with_text else flagged.drop(text), "flagged"), names, host, host_limit, broadcast_bytes, False)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rejected ones, columns as they were."""
    names = _names(docs)
    flagged = flags(docs, text, names["soft"], names["hard"])
    # a text beyond a hard limit is rejected whatever its host: only its masks are needed from here on
    held = materialise(flagged.withColumn(text, F.when(F.col(names["hard"]) == 0, F.col(text))), "flagged")
    return _verdicts(held, names, host, host_limit, broadcast_bytes, True).where(F.col(names["keep"])).select(*docs.columns)


#: the limits once more, as the SQL check reads them: written down apart from LIMITS, so that a slip in one shows
_SQL_LIMITS = {
    "symbols": ("symbols > 0.1 * words", "symbols > 0.3 * words"),
    "upper": ("words > 4 AND upper > chars / 4", "words > 4 AND upper > 0.4 * chars"),
    "repeats": ("words > 19 AND kinds < 0.3 * words", "words > 19 AND kinds < words / 5"),
    "nonalpha": ("words > 4 AND alpha < 0.75 * words", "words > 4 AND alpha < 0.6 * words"),
    "lines": ("lines > 3 AND line_kinds < 0.7 * lines", "lines > 3 AND line_kinds < lines / 2"),
    "length": ("words > 9 AND chars NOT BETWEEN 3 * words AND 12 * words", "words > 9 AND chars NOT BETWEEN 2.5 * words AND 20 * words"),
}


def _sql() -> str:
    def mask(which: int) -> str:
        return "CASE WHEN blank THEN 64 ELSE " + " + ".join(f"CASE WHEN {_SQL_LIMITS[r][which]} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES)) + " END"

    counts = ", ".join(f"sum((soft // {1 << i}) % 2) AS f_{r}" for i, r in enumerate(RULES))
    moments = ", ".join(f"avg(f_{r} / host_docs) AS m_{r}, var_pop(f_{r} / host_docs) AS v_{r}" for r in RULES)
    weights = ", ".join(f"CASE WHEN v_{r} > 0 THEN greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0) ELSE 1e6 END AS w_{r}, m_{r}" for r in RULES)
    bad = " + ".join(f"CASE WHEN round((m_{r} * w_{r} + f_{r}) / (w_{r} + host_docs), 6) > {HOST_LIMIT} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return f"""
WITH measured AS (
  SELECT doc_id, source, text IS NULL OR NOT regexp_matches(text, '[^ \\t\\r\\n]') AS blank,
    length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS words, len(regexp_extract_all(text, '[#$%&*|~^{{}}<>]')) AS symbols,
    len(regexp_extract_all(text, '\\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '[^ \\t\\r\\n]*\\p{{L}}[^ \\t\\r\\n]*')) AS alpha,
    len(list_distinct(regexp_split_to_array(text, '[ \\t\\r\\n]+'))) AS kinds, len(string_split(text, chr(10))) AS lines,
    len(list_distinct(string_split(text, chr(10)))) AS line_kinds
  FROM documents),
flagged AS (SELECT doc_id, source, CAST({mask(0)} AS INT) AS soft, CAST({mask(1)} AS INT) AS hard FROM measured),
counts AS (SELECT source, count(*) AS host_docs, {counts} FROM flagged GROUP BY source),
prior AS (SELECT {weights} FROM (SELECT {moments} FROM counts)),
hosts AS (SELECT source, host_docs, {bad} AS host_bad FROM counts, prior)
SELECT f.doc_id, f.source, f.soft, f.hard, h.host_docs, CAST(h.host_bad AS INT) AS host_bad,
  f.hard = 0 AND (f.soft & CAST(h.host_bad AS INT)) = 0 AS keep
FROM flagged f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source"""


SQL = _sql()
