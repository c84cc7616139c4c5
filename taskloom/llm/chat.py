"""Operator 6: chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import small_batches, table

# Control strings of this template and of others in use, each escaped wherever a text holds it.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, MID, END = "<|", "|>\n", "<|end|>\n"
TURN = re.compile(r"<\|((?:[^|\\]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    r"""Backslashes doubled, and one put after the first character of each control string; unescape() undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of logs of events.

    events: conv_id, seq, kind, target, role, text. Kinds: `message` begins a message;
    `delta` appends its text to the message whose seq is target; `edit` replaces that
    message's text (deltas of a higher seq append to it again); `regenerate` takes away
    the message with seq target and all after it, as far as they came before the event, and
    begins a message of its own. Other kinds and null kinds are ignored.

    A message's text is that of its last edit, or its own without one, and the deltas after it,
    joined once: the work grows with the log and not with its square. Order is seq, ties by
    kind and text; a group is one message, whatever its conversation holds. Null texts are
    empty; null roles are empty; rows of one seq are messages of their own, in the order of
    role and text, and share what is said of their seq. A null seq sorts first. A null conv_id
    is a conversation. No rows give no rows.
    """
    e = events.select("conv_id", "seq", "kind", "target", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    starts = e.where(F.col("kind").isin("message", "regenerate"))
    at = F.struct("seq", "text")
    last = F.max(F.when(F.col("kind") == "edit", at)).alias("last")
    deltas = F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", at))).alias("deltas")
    changes = e.where(F.col("kind").isin("delta", "edit")).groupBy(F.col("conv_id").alias("c"), F.col("target").alias("s")).agg(last, deltas)
    after_last = lambda x: F.col("last").isNull() | F.coalesce(x["seq"] > F.col("last.seq"), x["seq"].isNotNull() & F.col("last.seq").isNull())
    added = F.array_join(F.transform(F.filter("deltas", after_last), lambda x: x["text"]), "")
    changes = changes.select("c", "s", F.col("last.text").alias("edited"), added.alias("added"))
    m = starts.join(changes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s")), "left")
    text = F.concat(F.coalesce("edited", "text"), F.coalesce("added", F.lit("")))
    after = W.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    gone = F.min(F.when(F.col("kind") == "regenerate", F.col("target"))).over(after) <= F.col("seq")
    m = m.select("conv_id", "seq", "kind", "target", "role", text.alias("text")).withColumn("gone", gone)
    return m.where(~F.coalesce("gone", F.lit(False))).select("conv_id", "seq", "role", "text")


def rendered(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, seq, segment, loss_start, loss_end): the messages in the template, one segment each.

    A conversation's text is its segments in the order of seq; a segment of loss_role has the
    span (code points, within the segment) that is under the loss mask, others an empty one.
    A segment a row keeps a conversation of any length out of any one string. Rows of one
    seq are in the order of role and text, as in reconstruct().
    """
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MID))
    start = F.char_length(head).cast("long")
    end = F.when(F.col("role") == loss_role, start + F.char_length(body)).otherwise(start)
    return messages.select("conv_id", "seq", F.concat(head, body, F.lit(END)).alias("segment"), start.alias("loss_start"), end.cast("long").alias("loss_end"))


def unescaped(col: Column) -> Column:
    """unescape() as a column."""
    return F.when(F.contains(col, F.lit("\\")), F.regexp_replace(col, r"(?s)\\(.)", "$1")).otherwise(col)


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from rendered segments.

    Segments stream through in the order of seq, role and text, the last two as they are
    without escapes; only digests and counts of the conversation at hand are held. What is
    under the loss mask is looked up in the formatted text by its span.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out, state = None, [], None

        def close() -> None:
            if state is not None:
                out.append((None if at[0] else at[1], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for f in batches:
            for none, conv, segment, a, b in zip(f["none"], f["conv"], f["segment"], f["loss_start"], f["loss_end"], strict=True):
                if at != (none, conv):
                    close()
                    at, state = (none, conv), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in TURN.finditer(segment):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(segment[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    small_batches(segments.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    s = segments.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), "seq", "segment", "loss_start", "loss_end")
    role = F.expr(f"substring(segment, {len(START) + 1}, cast(loss_start AS int) - {len(START) + len(MID)})")
    text = F.expr(f"substring(segment, cast(loss_start AS int) + 1, char_length(segment) - cast(loss_start AS int) - {len(END)})")
    s = s.repartition("none", "conv").sortWithinPartitions("none", "conv", "seq", unescaped(role), unescaped(text))
    return s.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as events: every row begins a message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), "role", "text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(rendered(reconstruct(turn_events(turns))))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>'), '<s>', '<\s>'), '</s>', '<\/s>'),
        '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS esc FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + length(role) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
