"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar of a formatted conversation::

    chat := turn*
    turn := "<s>[INST]" role "|" mode "[/INST]" text "</s>"
    mode := "0" (text as it is) | "1" (text escaped)

A text may hold none of the four control strings. Texts are first rendered as they are and parsed again; texts of a
conversation whose parse differs from its turns are escaped where they conflict, and the parse must then be identical
(anything else raises). Escapes are & -> &amp;  < of <s>, </s> -> &lt;  [ of [INST], [/INST] -> &lb;  and, in roles, | -> &bar;
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (OPEN, CLOSE, HEAD, BODY)
ESCAPES = (("&", "&amp;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]"))
TURN = r"(?s)\A<s>\[INST\]([^|]*)\|([01])\[/INST\](.*)\z"


def _escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&lb;", "["), ("&bar;", "|"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _conflicts(c: Column) -> Column:
    out = F.lit(False)
    for s in CONTROL:
        out = out | F.contains(c, F.lit(s))
    return out


def _head(role: Column, mode: Column) -> Column:
    return F.concat(F.lit(OPEN + HEAD), F.replace(_escape(role), F.lit("|"), F.lit("&bar;")), F.lit("|"), mode, F.lit(BODY))


def _pieces(turns: Column, escape: bool) -> Column:
    """turns (role, text) -> (head, body, loss) as rendered."""

    def one(t: Column) -> Column:
        body = F.when(_conflicts(t["text"]), _escape(t["text"])).otherwise(t["text"]) if escape else t["text"]
        mode = F.when(_conflicts(t["text"]), F.lit("1")).otherwise(F.lit("0")) if escape else F.lit("0")
        return F.struct(_head(t["role"], mode).alias("head"), body.alias("body"), (t["role"] == "assistant").alias("loss"))

    return F.transform(turns, one)


def _render(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, mode, text), all null in a turn that the grammar doesn't allow."""
    segments = F.split(formatted, CLOSE)
    segments = F.slice(segments, 1, F.size(segments) - 1)

    def one(s: Column) -> Column:
        body = F.regexp_extract(s, TURN, 3)
        fits = s.rlike(TURN) & ~_conflicts(body)
        mode = F.regexp_extract(s, TURN, 2)
        return F.struct(
            F.when(fits, _unescape(F.regexp_extract(s, TURN, 1))).alias("role"),
            F.when(fits, mode).alias("mode"),
            F.when(fits, F.when(mode == "1", _unescape(body)).otherwise(body)).alias("text"),
        )

    return F.transform(segments, one)


def _plain(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _spans(pieces: Column) -> Column:
    """Start and length, in code points, of each body under the loss mask."""
    begin = common.scan(F.transform(pieces, lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE)), F.lit(0), "int", lambda at, n: at + n)
    under = lambda ends: F.transform(pieces, lambda p, i: F.when(p["loss"], F.struct((F.get(ends, i) - len(CLOSE) - F.char_length(p["body"])).alias("start"), F.char_length(p["body"]).alias("len"))))
    return common.let(begin, lambda ends: F.filter(under(ends), lambda s: s.isNotNull()))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans), one row a conversation, turns in order of turn.

    Null text or role counts as empty; null turns come first; equal turns are ordered by role, then text, and repeated rows stay.
    A null conv_id is one conversation. Other columns are ignored, whatever their names. An empty table gives an empty result. Texts of
    any length are taken whole; a conversation is one row of the output and so must fit in a row (2 GB).
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("rows"))
    c = c.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    c = c.withColumn("raw", _pieces(F.col("turns"), False))
    c = c.withColumn("same", _plain(parse(_render(F.col("raw")))) == F.col("turns"))
    c = c.withColumn("pieces", F.when(F.coalesce("same", F.lit(False)), F.col("raw")).otherwise(_pieces(F.col("turns"), True)))
    c = c.withColumn("formatted", _render(F.col("pieces")))
    held = F.coalesce(F.col("same"), F.lit(False)) | F.coalesce(_plain(parse(F.col("formatted"))) == F.col("turns"), F.lit(False))
    return c.select("conv_id", F.when(held, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation did not parse back"))).alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def loss_text(formatted: Column, spans: Column, parsed: Column) -> Column:
    """The text under the loss mask, cut out of the formatted string and unescaped."""
    modes = F.transform(F.filter(parsed, lambda t: t["role"] == "assistant"), lambda t: t["mode"])

    def one(s: Column, mode: Column) -> Column:
        cut = F.substring(formatted, s["start"] + 1, s["len"])
        return F.when(mode == "1", _unescape(cut)).otherwise(cut)

    return F.array_join(F.zip_with(spans, modes, one), "")
