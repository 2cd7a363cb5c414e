"""Chat formatting with DataFrame functions only.

A template declares the markers of each role, whether its text is learned from, and which
role may follow which. Turn order is checked by that finite-state machine; the operator
emits text segments, each with its loss flag, and the formatted text is their concatenation.

Every marker begins with one of a few reserved characters. Inside texts these characters,
and the escape character itself, are written as the escape character and a digit, so a
marker in the output is always a marker and the reader gets every text back unchanged.

Defined results: rows of a conversation are ordered by turn, then role, then text, nulls
first, so ties have one order; repeated rows are turns of their own. A null text or role is
an empty one. A role that the template does not know keeps its name in a general marker and
makes the turn order invalid. Rows without conv_id form one conversation. A conversation is one
output row, so it must fit in one; all before that is grouped by conversation. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
START, INVALID = "start", "invalid"


@dataclass(frozen=True)
class Turn:
    """Markers around a role's text, and whether the text is under the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`after` maps a state to the roles that may follow; a role is the state it leads to."""

    begin: str = "<s>"
    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("[OUT]", "</s>", loss=True),
        }
    )
    after: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)
    # around the name of a role that is not in `roles`, and behind its text
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")

    def reserved(self) -> str:
        """First characters of all markers."""
        markers = [self.begin, *self.other, *(m for t in self.roles.values() for m in (t.open, t.close))]
        first = sorted({m[0] for m in markers})
        if len(first) > 9 or ESCAPE in first:
            raise ValueError("markers must begin with at most 9 characters other than the escape character")
        return "".join(first)

    def escaped(self, text: Column) -> Column:
        codes = [(c, f"{ESCAPE}{i}") for i, c in enumerate(ESCAPE + self.reserved())]
        return reduce(lambda out, code: F.replace(out, F.lit(code[0]), F.lit(code[1])), codes, text)

    def unescaped(self, text: Column) -> Column:
        # the escape character itself comes last: before that each one belongs to its digit
        codes = [(c, f"{ESCAPE}{i}") for i, c in enumerate(ESCAPE + self.reserved())][::-1]
        return reduce(lambda out, code: F.replace(out, F.lit(code[1]), F.lit(code[0])), codes, text)


SEGMENT = "array<struct<text: string, loss: boolean>>"


def _segment(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: segments with loss flags, the last state, and whether the order is valid."""
    known = list(template.roles)
    by_role = lambda role, value, other: reduce(
        lambda rest, name: F.when(role == name, F.lit(value(template.roles[name]))).otherwise(rest), known, other
    )
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct("turn", role.alias("role"), text.alias("text"))
    grouped = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    def segments(turn: Column) -> Column:
        open_other = F.concat(F.lit(template.other[0]), template.escaped(turn["role"]), F.lit(template.other[1]))
        return F.array(
            _segment(by_role(turn["role"], lambda t: t.open, open_other), False),
            _segment(template.escaped(turn["text"]), by_role(turn["role"], lambda t: t.loss, F.lit(False))),
            _segment(by_role(turn["role"], lambda t: t.close, F.lit(template.other[2])), False),
        )

    allowed = F.array(*(F.lit(f"{state}\n{role}") for state, roles in template.after.items() for role in roles))
    step = lambda state, turn: F.when(F.array_contains(allowed, F.concat(state, F.lit("\n"), turn["role"])), turn["role"]).otherwise(F.lit(INVALID))
    state = F.aggregate("turns", F.lit(START), step)
    begin = F.array(_segment(F.lit(template.begin), False))
    return grouped.select(
        "conv_id",
        F.concat(begin, F.flatten(F.transform("turns", segments))).cast(SEGMENT).alias("segments"),
        state.alias("state"),
        state.isin(*template.final).alias("valid"),
    )


def read_turns(formatted_text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    quoted = lambda marker: "\\Q" + marker + "\\E"
    plain = "[^" + "".join("\\" + c for c in template.reserved()) + "]*+"
    opens = [*(quoted(t.open) for t in template.roles.values()), quoted(template.other[0]) + plain + quoted(template.other[1])]
    closes = [*(quoted(t.close) for t in template.roles.values()), quoted(template.other[2])]
    pattern = F.lit(f"({'|'.join(opens)})({plain})(?:{'|'.join(closes)})")
    marks, texts = (F.regexp_extract_all(formatted_text, pattern, F.lit(i)) for i in (1, 2))

    def turn(mark: Column, text: Column) -> Column:
        before, behind = len(template.other[0]), len(template.other[1])
        named = template.unescaped(F.substring(mark, F.lit(before + 1), F.length(mark) - (before + behind)))
        role = reduce(lambda rest, name: F.when(mark == template.roles[name].open, F.lit(name)).otherwise(rest), template.roles, named)
        return F.struct(role.alias("role"), template.unescaped(text).alias("text"))

    return F.zip_with(marks, texts, turn)


def formatted_digest(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests read back from the formatted texts and loss flags, with one fixed conversation besides."""
    spark = turns.sparkSession
    fixed = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    own = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long"), F.lit(t).cast("long"), F.lit(r), F.lit(fixed)) for t, r in enumerate(("user", "assistant"))))))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    done = formatted(rows.union(own.toDF(*(c.split()[0] for c in schema.split(", ")))), template)
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
    back = done.select("conv_id", "valid", whole.alias("formatted"), learned.alias("learned"))
    back = back.withColumn("turns", read_turns(F.col("formatted"), template))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


FORMATTED_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last
    FROM rows
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
          ELSE 20 + 2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) END))::BIGINT AS formatted_chars,
    bool_and((before || ' ' || role) IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user')
        AND (NOT is_last OR role = 'assistant')) AS valid
FROM turns GROUP BY conv_id
"""
