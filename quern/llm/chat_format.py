"""Chat formatting by grammar round trip.

A conversation is rendered as one text of turns::

    ### Role: text</turn>\\n

The rendered text is parsed again with a deterministic grammar; a turn that
does not come back as it was or that
holds a control string, is escaped, and the check is made once more on the
whole conversation.  Escaping is reversible by construction (`escape`),
so the second parse must give the source back; ``round_trip`` says that it did.

Defined results
---------------
* null text or role: the empty string;
* equal turn numbers: by role, then text; repeated rows are turns of their own;
* null turn number: first; null conv_id: one conversation of its own;
* an empty table gives an empty result; extra columns are ignored.
A conversation is one output row, so its text has to fit one task, as the
sequence it will become in training does.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
MARK = "### "
ROLE_END = ": "

#: (control string, its escaped form); the backslash itself comes first.
ESCAPES = [("\\", "\\\\"), (TURN_END, "\\e"), (MARK, "\\h"), (ROLE_END, "\\c")]


def _lit(s: str) -> Column:
    return F.lit(s)


def escape(c: Column) -> Column:
    """Replace every control string by a backslash form; no control string is left in the result."""
    for raw, out in ESCAPES:
        c = F.replace(c, _lit(raw), _lit(out))
    return c


def unescape(c: Column) -> Column:
    """Inverse of ``escape``; leaves lone backslashes before other characters as they are."""

    def part(p: Column) -> Column:
        for raw, out in ESCAPES[1:]:
            p = F.replace(p, _lit(out), _lit(raw))
        return p

    # Doubled backslashes are split off first, from left to right, so that the rest holds single ones only.
    return F.when(
        F.contains(c, _lit("\\")),
        F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\"),
    ).otherwise(c)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(_lit(MARK), role, _lit(ROLE_END), text, _lit(TURN_END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered text: array of (role, body, text), body being the text as it stands there."""
    pieces = F.split(formatted, TURN_END + "\n", -1)

    def turn(p: Column) -> Column:
        at = F.instr(p, ROLE_END)
        body = F.substr(p, at + len(ROLE_END))
        return F.struct(
            unescape(F.substr(p, _lit(len(MARK) + 1), at - len(MARK) - 1)).alias("role"),
            body.alias("body"),
            unescape(body).alias("text"),
        )

    return F.transform(F.slice(pieces, _lit(1), F.greatest(F.size(pieces) - 1, _lit(0))), turn)


def format_chat(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back), loss_spans, n_escaped, round_trip.

    ``loss_spans`` are (start, end) code points in ``formatted`` of the texts that
    carry loss.  ``n_escaped`` counts the turns that needed escaping.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))

    # Each turn is tried alone; what holds a control string or doesn't come back is escaped.
    def settled(t: Column) -> Column:
        plain = render_turn(t.role, t.text)
        back = F.get(parse(plain), F.lit(0))
        controls = [F.contains(x, _lit(m)) for x in (t.role, t.text) for m in (TURN_END, MARK)]
        fine = (back.role == t.role) & (back.text == t.text) & ~reduce(or_, controls)
        return F.when(fine, F.struct(plain.alias("out"), F.lit(0).alias("escaped"))).otherwise(
            F.struct(render_turn(escape(t.role), escape(t.text)).alias("out"), F.lit(1).alias("escaped"))
        )

    convs = convs.withColumn("rendered", F.transform("source", settled))
    convs = convs.select(
        "conv_id",
        "source",
        F.array_join(F.transform("rendered", lambda x: x.out), "").alias("formatted"),
        F.aggregate("rendered", F.lit(0), lambda a, x: a + x.escaped).alias("n_escaped"),
    )
    same = lambda turns_, source: F.transform(turns_, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))) == F.transform(source, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    convs = convs.withColumn("turns", parse(F.col("formatted"))).withColumn("round_trip", same(F.col("turns"), F.col("source")))
    return convs.select("conv_id", "formatted", "turns", loss_spans(F.col("formatted"), loss_roles).alias("loss_spans"), "n_escaped", "round_trip")


def loss_spans(formatted: Column, roles: tuple[str, ...]) -> Column:
    """(start, end) of the bodies of the given roles, from the lengths of the pieces of the rendered text."""
    step = len(TURN_END) + 1

    def add(acc: Column, p: Column) -> Column:
        at = F.instr(p, ROLE_END)
        role = unescape(F.substr(p, F.lit(len(MARK) + 1), at - len(MARK) - 1))
        start = acc.pos + at + len(ROLE_END) - 1
        end = acc.pos + F.length(p)
        return F.struct(
            (end + step).cast("int").alias("pos"),
            F.when(role.isin(*roles), F.concat(acc.spans, F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))))).otherwise(acc.spans).alias("spans"),
        )

    pieces = F.split(formatted, TURN_END + "\n", -1)
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), zero, add)["spans"]
