"""Conversations as items of a response log and as chat messages, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALL, OUTPUT, MESSAGE = "function_call", "function_call_output", "message"
#: What is said where the middle of a tool's output was left out.
CUT = "\n... [truncated {} chars]"
TOOL_CALLS = "array<struct<id:string,name:string,arguments:string>>"


def flat_name(namespace: Column, name: Column) -> Column:
    """namespace__name; a name without a namespace, or that has it already, stays."""
    n, lead = F.coalesce(name, F.lit("")), F.concat(namespace, F.lit("__"))
    return F.when((F.coalesce(namespace, F.lit("")) == "") | n.startswith(lead), n).otherwise(F.concat(lead, n))


def capped(output: Column, limit: int, mark: str = CUT) -> Column:
    """A tool's output up to limit characters, and how many were left out."""
    before, after = mark.split("{}")
    n = F.char_length(output)
    return F.when(n > limit, F.concat(F.substring(output, 1, limit), F.lit(before), (n - limit).cast("string"), F.lit(after))).otherwise(output)


def to_chat(items: DataFrame, limit: int | None = None) -> DataFrame:
    """(conv_id, place, role, content, tool_calls, tool_call_id) of items (conv_id, seq, type, role, text, call_id, namespace, name, arguments, output).

    Messages keep their role, developer being system, user where there is none. A call belongs to the assistant's message just before it,
    or else makes one without content; so of several calls in a row each but the first makes one. Outputs are tool
    messages that name their call, cut to `limit` characters if that is given. Other types are left out. Names are flat; a call without an id is named by its
    conversation and seq; arguments that are missing are {}.
    """
    w = W.partitionBy("conv_id").orderBy("seq")
    call_id = F.coalesce(F.nullif("call_id", F.lit("")), F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), F.col("seq").cast("string")))
    call = F.struct(call_id.alias("id"), flat_name(F.col("namespace"), F.col("name")).alias("name"), F.coalesce(F.nullif("arguments", F.lit("")), F.lit("{}")).alias("arguments"))
    is_call, said = F.col("type") == CALL, (F.col("type") == MESSAGE) & (F.col("role") == "assistant")
    d = items.where(F.col("type").isin(CALL, OUTPUT, MESSAGE)).withColumns({"_call": F.when(is_call, call), "_said": F.coalesce(said, F.lit(False))})
    d = d.withColumns({"_next": F.lead("_call").over(w), "_joins": is_call & F.coalesce(F.lag("_said").over(w), F.lit(False))}).where(~F.col("_joins"))
    role = F.when(is_call, "assistant").when(F.col("type") == OUTPUT, "tool").when(F.col("role") == "developer", "system").otherwise(F.coalesce(F.nullif("role", F.lit("")), F.lit("user")))
    output = F.coalesce("output", F.lit(""))
    content = F.when(is_call, F.lit(None).cast("string")).when(F.col("type") == OUTPUT, output if limit is None else capped(output, limit)).otherwise(F.coalesce("text", F.lit("")))
    calls = F.when(is_call, F.array("_call")).when(F.col("_said") & F.col("_next").isNotNull(), F.array("_next"))
    return d.select("conv_id", F.row_number().over(w).alias("place"), role.alias("role"), content.alias("content"), calls.alias("tool_calls"), F.when(F.col("type") == OUTPUT, F.coalesce("call_id", F.lit(""))).alias("tool_call_id"))


def to_items(messages: DataFrame, tools: DataFrame, preambles: bool = False) -> DataFrame:
    """Items as to_chat() takes them, of its messages; tools: flat, namespace, name.

    An assistant's calls are items of their own; what it says beside them is left out unless `preambles`, as a reader of items takes a message for the
    end of a turn. Blank assistant messages are none. Names in `tools` get their namespace back, others stay.
    """
    null = lambda name: F.lit(None).cast("string").alias(name)
    calls = F.coalesce("tool_calls", F.array().cast(TOOL_CALLS))
    speaks = F.when(F.col("role") == "assistant", (F.trim(F.coalesce("content", F.lit(""))) != "") & (F.lit(preambles) | (F.size(calls) == 0))).otherwise(True)
    said = F.when(F.col("role") != "tool", F.when(speaks, F.array(F.struct(F.lit(MESSAGE).alias("type"), "role", F.col("content").alias("text"), null("call_id"), null("flat"), null("arguments"), null("output")))))
    kind = "array<struct<type:string,role:string,text:string,call_id:string,flat:string,arguments:string,output:string>>"
    called = F.transform(calls, lambda c: F.struct(F.lit(CALL).alias("type"), null("role"), null("text"), c["id"].alias("call_id"), c["name"].alias("flat"), c["arguments"].alias("arguments"), null("output")))
    given = F.when(F.col("role") == "tool", F.array(F.struct(F.lit(OUTPUT).alias("type"), null("role"), null("text"), F.col("tool_call_id").alias("call_id"), null("flat"), null("arguments"), F.col("content").alias("output"))))
    every = F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (said, called, given)])
    d = messages.select("conv_id", "place", F.posexplode(every).alias("at", "x")).select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("place", "at")).alias("seq"), "x.*")
    named = d.join(tools.select("flat", "namespace", F.col("name").alias("_name")).dropDuplicates(["flat"]), "flat", "left")
    return named.select("conv_id", "seq", "type", "role", "text", "call_id", "namespace", F.coalesce("_name", "flat").alias("name"), "arguments", "output")


def paired_calls(items: DataFrame) -> DataFrame:
    """(conv_id, call_id, name, arguments, output, state): each call with the first output of its id; state paired, unanswered, or orphan for an output that no call has."""
    calls = items.where(F.col("type") == CALL).groupBy("conv_id", "call_id").agg(F.min_by(F.struct(flat_name(F.col("namespace"), F.col("name")).alias("name"), "arguments"), "seq").alias("c"))
    outputs = items.where(F.col("type") == OUTPUT).groupBy("conv_id", "call_id").agg(F.min_by(F.struct(F.coalesce("output", F.lit("")).alias("output")), "seq").alias("o"))
    d = calls.join(outputs, ["conv_id", "call_id"], "full")
    state = F.when(F.col("o").isNull(), "unanswered").when(F.col("c").isNull(), "orphan").otherwise("paired")
    return d.select("conv_id", "call_id", "c.name", "c.arguments", "o.output", state.alias("state"))
