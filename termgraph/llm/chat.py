"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, what stands before and after the content and whether the
content is trained on; the machine names the role that may follow each state and the states in which a
conversation may end.  A conversation is checked turn by turn (a fold over its ordered turns); a
valid one gives three segments a turn (opening, content, closing), each with its loss flag, an invalid one
gives a single row that names the first turn that broke the order.

One shuffle, by conversation, moves each text once; everything else is built-in expressions on the
JVM.

Defined cases: rows that repeat entirely (conversation, turn, role, text) count once; two different rows of one
turn are an error ("tie"); a NULL turn or role, or a role that the template doesn't know, is an error; a NULL
text is an empty content; an empty text gives an empty content segment; rows with a NULL conversation id belong to
no conversation and are dropped; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``parts``: role -> (before, after, is the content trained on); ``moves``: state -> roles that may follow
    (a state is the role read last; ``start`` at first); ``ends``: states in which a conversation may stop."""

    parts: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<|system|>\n", "<|end|>\n", False),
            "user": ("<|user|>\n", "<|end|>\n", False),
            "assistant": ("<|assistant|>\n", "<|end|>\n", True),
        }
    )
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def _literals(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def segments(turns: DataFrame, template: Template = DEFAULT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segment, turn, role, text, loss, error): the segments of each valid conversation in order, from 0;
    ``error`` is NULL there.  An invalid one has a single row with segment -1 and the error."""
    row = F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    held = turns.where(F.col(conversation).isNotNull()).groupBy(F.col(conversation).alias("conv_id")).agg(F.array_sort(F.array_distinct(F.collect_list(row))).alias("a"))
    allowed = _literals({f"{s} {r}": True for s, roles in template.moves.items() for r in roles})
    first = F.struct(F.lit("start").alias("s"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("e"))

    def step(state: Column, x: Column) -> Column:
        fault = (
            F.when(x.t.isNull(), "no turn")
            .when(x.t == state.t, F.concat(F.lit("tie at turn "), x.t.cast("string")))
            .when(x.r.isNull() | ~F.coalesce(allowed[F.concat_ws(" ", state.s, x.r)], F.lit(False)), F.concat(F.lit("turn "), x.t.cast("string"), F.lit(": "), F.coalesce(x.r, F.lit("no role")), F.lit(" after "), state.s))
        )
        return F.struct(F.coalesce(x.r, F.lit("")).alias("s"), x.t.cast("long").alias("t"), F.coalesce(state.e, fault).alias("e"))

    ended = F.aggregate("a", first, step)
    checked = held.withColumn("z", ended).select("conv_id", "a", F.coalesce("z.e", F.when(~F.col("z.s").isin(*template.ends), F.concat(F.lit("ends after "), F.col("z.s")))).alias("error"))
    before, after, loss = (_literals({r: p[i] for r, p in template.parts.items()}) for i in range(3))

    def parts(x: Column) -> Column:
        piece = lambda t, flag: F.struct(x.t.cast("long").alias("turn"), x.r.alias("role"), t.alias("text"), flag.alias("loss"))
        return F.array(piece(before[x.r], F.lit(False)), piece(x.x, loss[x.r]), piece(after[x.r], loss[x.r]))

    empty = F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("loss"))
    out = checked.select("conv_id", "error", F.posexplode(F.when(F.col("error").isNull(), F.flatten(F.transform("a", parts))).otherwise(F.array(empty))).alias("n", "p"))
    return out.select("conv_id", F.when(F.col("error").isNull(), F.col("n")).otherwise(-1).cast("int").alias("segment"), "p.turn", "p.role", "p.text", "p.loss", "error")


def _sql(template: Template = DEFAULT) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    allowed = ", ".join(f"({q(s)}, {q(r)})" for s, roles in template.moves.items() for r in roles)
    parts = ", ".join(f"({q(r)}, {q(b)}, {q(a)}, {str(loss).lower()})" for r, (b, a, loss) in template.parts.items())
    return f"""
WITH one AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER w AS place, coalesce(CASE WHEN row_number() OVER w = 1 THEN 'start' ELSE coalesce(lag(role) OVER w, '') END, '') AS state, lag(turn) OVER w AS was
  FROM one WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
faults AS (SELECT *, CASE WHEN turn IS NULL THEN 'no turn' WHEN turn = was THEN 'tie at turn ' || turn
    WHEN role IS NULL OR (state, role) NOT IN ({allowed}) THEN 'turn ' || turn || ': ' || coalesce(role, 'no role') || ' after ' || state END AS fault FROM placed),
judged AS (SELECT conv_id, coalesce(arg_min(fault, place) FILTER (fault IS NOT NULL), CASE WHEN coalesce(arg_max(coalesce(role, ''), place), '') NOT IN ({", ".join(map(q, template.ends))}) THEN 'ends after ' || arg_max(coalesce(role, ''), place) END) AS error
  FROM faults GROUP BY conv_id),
parts(role, opening, closing, loss) AS (VALUES {parts})
SELECT p.conv_id, CAST((p.place - 1) * 3 + k AS INT) AS segment, CAST(p.turn AS BIGINT) AS turn, p.role, CASE k WHEN 0 THEN t.opening WHEN 1 THEN p.text ELSE t.closing END AS text, k > 0 AND t.loss AS loss, j.error
FROM placed p JOIN judged j USING (conv_id) JOIN parts t USING (role), range(3) r(k) WHERE j.error IS NULL
UNION ALL SELECT conv_id, -1, NULL, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL"""


SQL = _sql()
