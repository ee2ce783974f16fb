"""Event-sourced reconstruction of conversations, and their rendering with a loss mask.

A log holds events of conversations: a message, a streamed delta of its text, an edit, a regeneration, a
deletion. Logs are partitioned by conversation and a range of messages, sorted, and folded into the final
messages, runs of deltas being joined first, so that a stream of many costs no more than its text; ranges then meet, sorted, in one row for each conversation, since a rendered conversation is one
string. DataFrame functions only.

The template marks turns with control strings. Inside texts, control strings of this and of other common
templates are broken up by an escape that unescape() undoes exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Beginnings of control strings: their first character is followed by an escape inside texts.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
RANGE = 256


def escape(text: Column) -> Column:
    """A backslash becomes \\e; \\p parts the first character of a control string from the rest."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\e")), CONTROL, r"$1\\p")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def _joined(events: Column) -> Column:
    """Sorted events, with each run of deltas of one message as one event: part of the message, edit or
    regeneration before it, or a delta of its own after a deletion or where nothing was begun.
    """
    numbers = F.sequence(F.lit(0), F.size(events) - 1)
    at = lambda i: F.get(events, i)
    starts = F.filter(numbers, lambda i: (i == 0) | (at(i)["kind"] != "delta") | (at(i - 1)["kind"] == "delete") | ~at(i)["message"].eqNullSafe(at(i - 1)["message"]))

    def run(bounds: Column) -> Column:
        first = at(bounds["start"])
        text = F.array_join(F.transform(F.slice(events, bounds["start"] + 1, bounds["end"] - bounds["start"]), lambda e: e["text"]), "")
        return F.struct(first["message"].alias("message"), first["kind"].alias("kind"), first["role"].alias("role"), text.alias("text"))

    # a lambda, so that the starts are found once
    spans = F.flatten(F.transform(F.array(starts), lambda s: F.transform(s, lambda x, k: F.struct(x.alias("start"), F.coalesce(F.get(s, k + 1), F.size(events)).alias("end")))))
    return F.transform(spans, run)


def fold_events(log: DataFrame) -> DataFrame:
    """conv_id, messages: array of (message, role, text) in order, from conv_id, message, seq, kind, role, text.

    Kinds: "message" (also null) begins a message; "delta" appends to the text of the message last begun
    under its number, "edit" and "regenerate" replace it, "delete" removes it; where none was begun, a
    delta, edit or regeneration begins one. Events of a message apply by seq, equal ones by kind, role and
    text; so repeated rows give repeated messages. Null text and role count as empty, a null conv_id is a
    conversation of its own, a null message or seq comes first. A conversation whose messages are all
    deleted has none; an empty log gives no rows. Other columns are not read.
    """
    event = F.struct("message", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = log.select("conv_id", F.floor(F.col("message") / RANGE).alias("range"), event.alias("event")).groupBy("conv_id", "range").agg(F.sort_array(F.collect_list("event")).alias("events"))

    def step(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        open_ = (F.size(done) > 0) & last["message"].eqNullSafe(e["message"])
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        new = F.array(F.struct(e["message"].alias("message"), e["role"].alias("role"), e["text"].alias("text")))
        text = F.when(e["kind"] == "delta", F.concat(last["text"], e["text"])).otherwise(e["text"])
        changed = F.array(F.struct(last["message"].alias("message"), last["role"].alias("role"), text.alias("text")))
        return (
            F.when(e["kind"] == "delete", F.when(open_, before).otherwise(done))
            .when((e["kind"] == "message") | ~open_, F.concat(done, new))
            .otherwise(F.concat(before, changed))
        )

    kind = f"array<struct<message:{log.schema['message'].dataType.simpleString()},role:string,text:string>>"
    folded = ranges.select("conv_id", "range", F.aggregate(_joined(F.col("events")), F.array().cast(kind), step).alias("messages"))
    return folded.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("range", "messages"))), lambda r: r["messages"])).alias("messages"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_runs: run lengths in code points over formatted, three for each turn (its
    head, its text, its end), and whether each is under the loss mask: texts of loss_role are.
    """
    def head(m: Column) -> Column:
        return F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT))

    def runs(m: Column) -> Column:
        run = lambda n, loss: F.struct(n.cast("long").alias("n"), loss.alias("loss"))
        return F.array(run(F.length(head(m)), F.lit(False)), run(F.length(escape(m["text"])), m["role"] == loss_role), run(F.lit(len(END)), F.lit(False)))

    return conversations.select(
        "conv_id",
        F.concat_ws("", F.transform("messages", lambda m: F.concat(head(m), escape(m["text"]), F.lit(END)))).alias("formatted"),
        F.flatten(F.transform("messages", runs)).alias("loss_runs"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) parsed from formatted, and loss_texts: what the mask covers."""
    turns = F.filter(F.split("formatted", r"(?=<\|turn\|>)"), lambda t: t != "")

    def parse(t: Column) -> Column:
        marked = F.substring_index(t, TEXT, 1)
        text = F.substring(t, F.length(marked) + F.lit(len(TEXT) + 1), F.length(t) - F.length(marked) - F.lit(len(TEXT) + len(END)))
        return F.struct(unescape(F.substring(marked, F.lit(len(TURN) + 1), F.length(marked))).alias("role"), unescape(text).alias("text"))

    def masked(t: Column, i: Column) -> Column:
        run = lambda k: F.get("loss_runs", i * 3 + k)
        covered = lambda k, before: F.when(run(k)["loss"], F.substring(t, (before + 1).cast("int"), run(k)["n"].cast("int"))).otherwise("")
        first, second = run(0)["n"], run(0)["n"] + run(1)["n"]
        return unescape(F.concat(covered(0, F.lit(0)), covered(1, first), covered(2, second)))

    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(turns, parse).alias("turns"), F.transform(turns, masked).alias("loss_texts"))
