"""Chat formatting by a finite-state machine over roles, in built-in functions only.

A template states for each role what opens and closes its turn and whether its text is trained on, and which role may
follow which. Conversations are ordered turn by turn, the machine says whether the order is valid, and segments with
their loss flags come out; their texts joined are the formatted conversation. Texts cannot contain the template's own
strings: a backslash goes into each of them and before each backslash, and reading back takes these away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn]
    #: (state, role) to the next state; others are invalid. The first state is "start".
    moves: dict[tuple[str, str], str]
    ends: tuple[str, ...]
    #: Around the name of a role that the template doesn't know, and after its text.
    other: tuple[str, str, str] = ("<|", "|>", "<|end|>")
    more: tuple[str, ...] = field(default=())

    def controls(self) -> list[str]:
        """All strings that texts must not contain; longer ones first."""
        own = {s.strip() for t in self.roles.values() for s in (t.opens, t.closes)} | set(self.other) | set(self.more)
        return sorted((s for s in own if len(s) > 1), key=lambda s: (-len(s), s))


INSTRUCT = Template(
    roles={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn(" ", "</s>", loss=True)},
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    ends=("assistant",),
    more=("<s>",),
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in template.controls():
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(role: Column, text: Column, template: Template) -> Column:
    """A turn's segments: array of (text, loss)."""
    part = lambda s, loss=False: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    body = escape(text, template)
    a, b, c = (F.lit(s) for s in template.other)
    out = F.array(part(F.concat(a, escape(role, template), b)), part(body), part(c))
    for name, turn in template.roles.items():
        out = F.when(role == name, F.array(part(F.lit(turn.opens)), part(body, turn.loss), part(F.lit(turn.closes)))).otherwise(out)
    return out


def machine(roles: Column, template: Template) -> Column:
    """Whether the roles in order are a walk of the template's machine to one of its ends."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("")
        for (s, r), to in template.moves.items():
            out = F.when((state == s) & (role == r), to).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step).isin(*template.ends)


def format_conversations(chats: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, valid, formatted, segments (array of text and loss, in order).

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. Null roles and
    texts are empty strings. Roles that the template doesn't know are formatted under their names and make the order
    invalid; invalid conversations are formatted too. Rows with a null id are one conversation. An empty table gives
    no rows.
    """
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = chats.select(F.col(conv), F.struct(F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), segments(r, t, template).alias("parts")).alias("row"))
    turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    made = turns.select(conv, machine(F.col("rows.role"), template).alias("valid"), F.flatten("rows.parts").alias("segments"))
    return made.select(conv, "valid", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    q = lambda s: re.escape(s).replace("\\\n", "\\n")
    a, b, c = template.other
    shapes = [f"{q(t.opens)}.*?{q(t.closes)}" for t in template.roles.values()] + [f"{q(a)}.*?{q(b)}.*?{q(c)}"]
    cut = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def turn(s: Column) -> Column:
        name = F.substring_index(F.substr(s, F.lit(len(a) + 1)), b, 1)
        start = F.length(name) + len(a) + len(b) + 1
        out = F.struct(unescape(name).alias("role"), unescape(F.substr(s, start, F.length(s) - start + 1 - len(c))).alias("text"))
        for role, t in reversed(template.roles.items()):
            body = F.substr(s, F.lit(len(t.opens) + 1), F.length(s) - (len(t.opens) + len(t.closes)))
            out = F.when(F.startswith(s, F.lit(t.opens)), F.struct(F.lit(role).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(cut, turn)


def digests(chats: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id") -> DataFrame:
    """What reading the formatted conversations back gives: conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid."""
    made = format_conversations(chats, template, conv)
    read = made.select(conv, "valid", "formatted", read_back(F.col("formatted"), template).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("trained"))
    told = read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join(F.transform("trained", lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    return told.select(conv, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


def oracle_sql(template: Template = INSTRUCT) -> str:
    """The digests over ``conversations`` and one conversation of control strings, for DuckDB."""
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for s in template.controls():
            out = f"replace({out}, {lit(s)}, {lit(s[0] + chr(92) + s[1:])})"
        return out

    around = " ".join(f"when {lit(r)} then {len(t.opens) + len(t.closes)}" for r, t in template.roles.items())
    trained = ", ".join(lit(r) for r, t in template.roles.items() if t.loss)
    moves = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in template.moves)  # states bear the names of roles
    ends = ", ".join(map(lit, template.ends))
    return f"""
with source as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, row_number() over w as k, coalesce(lag(role) over w, 'start') as before, lead(role) over w as after
  from source window w as (partition by conv_id order by turn nulls first, role, text)),
sized as (
  select *, length({escaped("text")}) + case role {around} else {sum(map(len, template.other))} + length({escaped("role")}) end as chars
  from placed)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(case when role in ({trained}) then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role in ({trained}) then text end, '' order by k), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  bool_and((before, role) in ({moves})) and bool_or(after is null and role in ({ends})) as valid
from sized group by conv_id"""
