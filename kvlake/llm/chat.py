"""Operator 4, chat formatting with a grammar round trip. DataFrame functions only.

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    other      <<ROLE:name>>text<</ROLE>>      (the name percent-encoded)

A conversation is rendered, the rendered text is parsed again and the recovered turns are compared with the source. Where they
differ, control strings inside its texts are escaped and it is rendered and compared again: the run of backslashes
between a control string's bracket and its name grows by one, which reading takes back. The second rendering always
recovers its source; ``exact`` says so for each conversation.

Defined results: turns go by (turn, role, text), nulls first; null text and null role count as empty; repeated rows are turns of their
own; an empty table gives no rows. A conversation's digest covers all its turns, so its turns meet in one row: that row,
not a table of conversations, must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, total

#: Marks of roles: begin and end. Fixed values.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE:", "<</ROLE>>")
NAMES = r"(INST\]|s>|SYS>>|ROLE)"
OPEN = r"(\[/?|<{1,2}/?)"
TURN = r"(?s)(?:<s>.*?</s>|\[INST\].*?\[/INST\]|<<SYS>>.*?<</SYS>>|<<ROLE:[^>]*>>.*?<</ROLE>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{OPEN}(\\*){NAMES}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{OPEN}\\(\\*){NAMES}", r"$1$2$3")


def _render(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = t["role"], escape(t["text"]) if escaped else t["text"]
        out = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(">>"), text, F.lit(OTHER[1]))
        for name, (begin, end) in MARKS.items():
            out = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted text, or null if it isn't wholly made of turns."""

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"^<<ROLE:([^>]*)>>", 0)
        inner = lambda begin, end: x.substr(F.length(begin) + 1, F.length(x) - F.length(begin) - F.length(end))
        role = F.url_decode(F.regexp_extract(x, r"^<<ROLE:([^>]*)>>", 1))
        text = inner(head, F.lit(OTHER[1]))
        for name, (begin, end) in MARKS.items():
            is_it = F.startswith(x, F.lit(begin))
            role, text = F.when(is_it, F.lit(name)).otherwise(role), F.when(is_it, inner(F.lit(begin), F.lit(end))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return let(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), lambda found: F.when(F.array_join(found, "") == formatted, F.transform(found, one)))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns, formatted, escaped, exact): one row for each conversation; turns are read back from formatted."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    source = whole.select("id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))

    def tried(source: Column) -> Column:
        keep = lambda escaped: lambda text: F.struct(text.alias("formatted"), parse(text).alias("turns"), F.lit(escaped).alias("escaped"))
        plain = let(_render(source, False), keep(False))
        return let(plain, lambda p: F.when(p["turns"].eqNullSafe(source), p).otherwise(let(_render(source, True), keep(True))))

    done = source.select("id", "source", let(F.col("source"), tried).alias("d"))
    return done.select(F.col("id").alias(id_col), "d.turns", "d.formatted", "d.escaped", F.col("d.turns").eqNullSafe(F.col("source")).alias("exact"))


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The digest columns of formatted conversations, all from what was read back."""
    said = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        total(F.transform(said, lambda x: F.length(x))).alias("loss_chars"),
        F.sha2(F.array_join(said, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "exact",
    )
