"""Sessions, votes, splits, rewards and filters: from rollouts to training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_order_key

# Roles of stored conversations, markers of a turn's end, outcomes that may vote.
ROLES = {"user": "human", "system": "human", "tool": "human", "assistant": "gpt"}
TURN_END = r"(?:\s*(?:<\|im_end\|>|<\|endoftext\|>))+\s*$"
VOTES = ("ok", "recovered_stdout")
NO_ANSWER = "SELECT NULL;"


def role_of(role: Column) -> Column:
    out = F.lit("human")
    for k, v in ROLES.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def packed(turns: DataFrame) -> DataFrame:
    """(id, system, conversations): one row a conversation of turns (conv_id, turn, role, text, and tool_calls, an array of structs with name and arguments, if there are any).

    System texts are hoisted into one, joined by blank lines; tool texts are wrapped as
    responses; an assistant's calls follow its text, each wrapped as a call, without white space at either end of the whole; a null text is
    empty; conversations of fewer than two turns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    tool = F.concat(F.lit("<tool_response>\n"), text, F.lit("\n</tool_response>"))
    said = text
    if "tool_calls" in turns.columns:
        call = lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
        said = F.concat(text, F.array_join(F.transform(F.coalesce("tool_calls", F.array().cast(turns.schema["tool_calls"].dataType)), call), ""))
    value = F.when(F.col("role") == "tool", tool).when(F.col("role") == "assistant", F.regexp_replace(said, r"^\s+|\s+$", "")).otherwise(text)
    item = F.struct("turn", F.struct(role_of(F.col("role")).alias("from"), value.alias("value")).alias("m"))
    g = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "system", item))).alias("c"),
    )
    system = F.concat_ws("\n\n", F.filter(F.transform("s", lambda x: x["text"]), lambda t: F.trim(t) != ""))
    return g.select(F.col("conv_id").alias("id"), system.alias("system"), F.transform("c", lambda x: x["m"]).alias("conversations")).where(F.size("conversations") >= 2)


def prefix_split(turns: DataFrame) -> DataFrame:
    """(conv_id, step, prefix, answer): one row an assistant turn with all turns before it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    before = F.collect_list(F.struct("role", "text")).over(w.rowsBetween(W.unboundedPreceding, -1))
    step = F.count(F.when(F.col("role") == "assistant", 1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("prefix", before).withColumn("step", step).where("role = 'assistant'").select("conv_id", "step", "prefix", F.col("text").alias("answer"))


def first_per_task(sessions: DataFrame) -> DataFrame:
    """The first session of each task in the order of path."""
    return sessions.groupBy("task").agg(F.min_by(F.struct(*sessions.columns), "path").alias("s")).select("s.*")


def parse_sessions(events: DataFrame) -> DataFrame:
    """(session, prompt, turns) of events (session, seq, type, role, text, tool): sessions that submitted a query.

    The prompt is the last user message with a text before the first submission; turns are
    assistant messages and tool results in order. A session without either is left out.
    """
    first = F.min(F.when(F.col("tool") == "sql_submit", F.col("seq"))).over(W.partitionBy("session"))
    asked = (F.col("type") == "user/message") & F.col("text").isNotNull() & (F.col("seq") < F.col("_submitted"))
    g = events.withColumn("_submitted", first).groupBy("session").agg(
        F.max_by(F.when(asked, F.col("text")), F.when(asked, F.col("seq"))).alias("prompt"),
        F.sort_array(F.collect_list(F.when(F.col("type").isin("assistant/message", "tool/result"), F.struct("seq", "type", "text")))).alias("turns"),
        F.max("_submitted").alias("submitted"),
    )
    return g.where("submitted IS NOT NULL AND prompt IS NOT NULL").select("session", "prompt", F.transform("turns", lambda t: F.struct(t["type"].alias("type"), t["text"].alias("text"))).alias("turns"))


def majority_vote(seeds: DataFrame) -> DataFrame:
    """(instance_id, res_hash, votes, n_valid, seed, method): the answer that most valid seeds give.

    seeds: instance_id, seed, exec_ok, outcome, res_hash, sql. Ties go to the hash that was seen
    at the smallest seed, and the answer's own first seed is chosen. Where no seed is valid, the first
    with a text other than NO_ANSWER stands, whether it ran or not, else the first of all, with no votes.
    """
    ok = F.coalesce(F.col("exec_ok") & F.col("outcome").isin(*VOTES) & F.col("res_hash").isNotNull(), F.lit(False))
    s = seeds.withColumn("ok", ok)
    hashes = s.where("ok").groupBy("instance_id", "res_hash").agg(F.count("*").alias("votes"), F.min("seed").alias("seed"))
    won = hashes.groupBy("instance_id").agg(F.max_by(F.struct("res_hash", "votes", "seed"), F.struct("votes", -F.col("seed"))).alias("w"), F.sum("votes").alias("n_valid"))
    said = (F.coalesce("sql", F.lit("")) != "") & (F.col("sql") != NO_ANSWER)
    nothing = ~F.coalesce(said, F.lit(False))
    rest = s.groupBy("instance_id").agg(F.min_by(F.struct("res_hash", F.lit(0).cast("long").alias("votes"), "seed"), F.struct(nothing, F.col("seed"))).alias("r"), F.min(nothing).alias("silent"))
    out = rest.join(won, "instance_id", "left").withColumn("x", F.coalesce("w", "r"))
    method = F.when(F.col("w").isNotNull(), "majority_vote").when(F.col("silent"), "fallback_default").otherwise("fallback_non_empty")
    return out.select("instance_id", "x.res_hash", "x.votes", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), "x.seed", method.alias("method"))


def seed_agreement(seeds: DataFrame) -> DataFrame:
    """(instance_id, n, n_correct, hashes, first_correct, decision) of seeds (instance_id, seed, res_hash, gold_res_hash)."""
    right = F.col("res_hash") == F.col("gold_res_hash")
    g = seeds.groupBy("instance_id").agg(F.count("*").alias("n"), F.count_if(right).alias("n_correct"), F.countDistinct("res_hash").alias("hashes"), F.min(F.when(right, F.col("seed"))).alias("first_correct"))
    return g.withColumn("decision", F.when(F.col("n_correct") == F.col("n"), "all").when(F.col("n_correct") > 0, "some").otherwise("reject"))


def outcome(sql: Column, exec_ok: Column, timed_out: Column, from_stdout: Column) -> Column:
    return F.when(timed_out, "timeout").when(sql.isNull() | (F.trim(sql) == ""), "no_sql").when(~exec_ok, "error").when(from_stdout, "recovered_stdout").otherwise("ok")


def run_summary(results: DataFrame) -> DataFrame:
    """(outcome, n, mean_s, max_s)."""
    return results.groupBy("outcome").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s"))


def token_stats(usage: DataFrame) -> DataFrame:
    """(task, sessions, input, output, peak, calls): sums by task of sessions' usage, and the largest prompt.

    usage: task, session, input_tokens, output_tokens, tool.
    """
    s = usage.groupBy("task", "session").agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.max("input_tokens").alias("peak"), F.count("tool").alias("calls"))
    return s.groupBy("task").agg(F.count("*").alias("sessions"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.max("peak").alias("peak"), F.sum("calls").alias("calls"))


def tokens_by_outcome(stats: DataFrame, correct: DataFrame) -> DataFrame:
    """(correct, tasks, input, output, tokens_a_correct) of token_stats() and (task, correct)."""
    d = stats.join(correct, "task")
    g = d.groupBy("correct").agg(F.count("*").alias("tasks"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    total = d.agg((F.sum(F.col("input") + F.col("output")) / F.nullif(F.count_if("correct"), F.lit(0))).alias("tokens_a_correct"))
    return g.join(F.broadcast(total), F.lit(True))  # total is one row


def holdout(rows: DataFrame, stratum: str, key: str, quota: int, seed: str, buckets: int = 1 << 16) -> DataFrame:
    """rows with held_out: exactly `quota` of each stratum, or all of a smaller one, by a seeded hash of the key; null is a stratum.

    Rows are counted by stratum and leading digits of the hash. The bucket in which a stratum's quota ends is its edge: buckets before it
    are held out whole and those behind it not at all, where the rows are; only rows of the edge, one of `buckets` if keys are different, are
    ordered. So a stratum that has nearly all rows is spread over as many tasks as its rows are.
    """
    order = F.sha2(F.concat(F.lit(seed.encode() + b"\0"), F.col(key).cast("string").cast("binary")), 256)
    d = rows.withColumn("_order", order).withColumn("_bucket", F.coalesce(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % buckets, F.lit(-1)))
    counts = d.groupBy(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy("_stratum").orderBy("_b")))
    edge = upto.where(F.col("_upto") - F.col("_n") < quota).groupBy("_stratum").agg(F.max("_b").alias("_edge"), (F.lit(quota) - F.max(F.struct("_b", F.col("_upto") - F.col("_n")))["col2"]).alias("_open"))
    d = d.join(edge, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    on_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    clear = d.where(~on_edge).withColumn("held_out", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)))
    close = d.where(on_edge).withColumn("held_out", F.row_number().over(W.partitionBy("_stratum").orderBy("_order", key)) <= F.col("_open"))
    return clear.unionByName(close).select(*rows.columns, "held_out")


def partition_errors(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """(key, n): keys of whole that are not in exactly one part, and keys of parts that are not in whole."""
    inside = parts[0].select(key)
    for p in parts[1:]:
        inside = inside.unionByName(p.select(key))
    n = inside.groupBy(key).agg(F.count("*").alias("n"))
    all_keys = whole.select(key).distinct().withColumn("known", F.lit(True))
    return all_keys.join(n, key, "full").where(~(F.coalesce("known", F.lit(False)) & (F.coalesce("n", F.lit(0)) == 1))).select(key, F.coalesce("n", F.lit(0)).alias("n"))


def seeded_shuffle(rows: DataFrame, key: str, seed: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.sha2(F.concat(F.lit(seed.encode() + b"\0"), F.col(key).cast("string").cast("binary")), 256), key)
    return out if limit is None else out.limit(limit)


def describe_sources(rows: DataFrame) -> DataFrame:
    """(source, databases, n, least, most) of rows (source, database)."""
    g = rows.groupBy("source", "database").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.count("*").alias("databases"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"))


def reward(answers: DataFrame) -> DataFrame:
    """answers with reward and reason: the first rule that holds.

    answers: sql, error, ordered_equal, values_equal, aliases_public.
    """
    rules = [
        (F.col("sql").isNull() | (F.trim("sql") == ""), 0.0, "no_sql"), (F.col("error").isNotNull(), 0.0, "exec_error"), (F.col("ordered_equal"), 1.0, "correct"),
        (F.col("values_equal") & ~F.col("aliases_public"), 1.0, "correct_values_only"), (F.col("values_equal"), 0.0, "wrong_column_names"),
    ]
    made = lambda r, why: F.struct(F.lit(r).alias("reward"), F.lit(why).alias("reason"))
    out = made(0.0, "wrong_result")
    for test, r, why in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), made(r, why)).otherwise(out)
    return answers.withColumn("_o", out).select(*answers.columns, "_o.reward", "_o.reason")


def replay_summary(replays: DataFrame) -> DataFrame:
    """(database, n, failed, ids): replays (database, instance_id, reward) that did not come to 1."""
    bad = F.col("reward") != 1.0
    return replays.groupBy("database").agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"), F.sort_array(F.collect_list(F.when(bad, F.col("instance_id")))).alias("ids"))


def whole_groups(samples: DataFrame) -> DataFrame:
    """Samples of groups without an aborted member."""
    bad = samples.groupBy("group").agg(F.bool_or(F.col("status") == "ABORTED").alias("aborted")).where("aborted").select("group")
    return samples.join(bad, "group", "left_anti")


def varied_groups(samples: DataFrame, least: float = 1e-6) -> DataFrame:
    """(group, std): groups whose trajectories, one reward each, differ; samples: group, trajectory, reward."""
    one = samples.groupBy("group", "trajectory").agg(F.first("reward").alias("reward"))
    return one.groupBy("group").agg(F.stddev_samp("reward").alias("std")).where(F.col("std") > least)


def collapse(runs: DataFrame, after: int = 2, initial: int = 5) -> DataFrame:
    """(run, first_alarm): runs whose rollouts (run, rollout_id, mean_reward) fall to zero for `after` in a row, or begin with `initial` zeros."""
    w = W.partitionBy("run").orderBy("rollout_id")
    zero = F.col("mean_reward") == 0
    d = runs.withColumn("island", F.sum(F.when(zero, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.where(zero).withColumn("streak", F.row_number().over(W.partitionBy("run", "island").orderBy("rollout_id")))
    alarm = F.when(F.col("island") > 0, F.col("streak") >= after).otherwise(F.col("streak") >= initial)
    return d.where(alarm).groupBy("run").agg(F.min("rollout_id").alias("first_alarm"))


def hoisted(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with system and developer texts in one leading message, joined by blank lines."""
    lead = F.col("role").isin("system", "developer")
    texts = messages.where(lead & (F.trim("text") != "")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    head = texts.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.concat_ws("\n\n", F.transform("t", lambda x: x["text"])).alias("text"))
    return head.unionByName(messages.where(~lead).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))


def strip_turn_end(text: Column) -> Column:
    return F.regexp_replace(text, TURN_END, "")


def collapsed_repeats(messages: DataFrame) -> DataFrame:
    """Messages without an assistant message that repeats the one before it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    again = (F.col("role") == "assistant") & (F.lag("role").over(w) == "assistant") & (F.lag("text").over(w) == F.col("text"))
    return messages.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again")).drop("_again")


def merged_calls(messages: DataFrame) -> DataFrame:
    """Function calls (role function_call) as tool_calls of the assistant message before them, whose preamble goes."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    m = messages.withColumn("_at", F.max(F.when(F.col("role") != "function_call", F.col("turn"))).over(w)).withColumn("_at", F.coalesce("_at", "turn"))
    g = m.groupBy("conv_id", "_at").agg(
        F.min_by(F.struct("role", "text"), "turn").alias("h"), F.sort_array(F.collect_list(F.when(F.col("role") == "function_call", F.struct("turn", "text")))).alias("calls"),
    )
    calls = F.transform("calls", lambda c: c["text"])
    has = F.size("calls") > 0
    role = F.when(F.col("h.role") == "function_call", "assistant").otherwise(F.col("h.role"))
    return g.select("conv_id", F.col("_at").alias("turn"), role.alias("role"), F.when(~has | (role != "assistant"), F.col("h.text")).alias("text"), calls.alias("tool_calls"))


def empty_response(content: Column, refusal: Column, tool_calls: Column) -> Column:
    """Whether a response has neither text nor a call; reasoning alone is empty."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return blank(content) & blank(refusal) & (F.coalesce(F.size(tool_calls), F.lit(0)) <= 0)


def merged_sets(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All packed rows of parts with one schema, and the ids that occur more than once."""
    out = parts[0]
    for p in parts[1:]:
        if p.schema.simpleString() != out.schema.simpleString():
            raise ValueError(f"schemas differ: {p.schema.simpleString()} and {out.schema.simpleString()}")
        out = out.unionByName(p)
    return out, out.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def verified(results: DataFrame) -> DataFrame:
    """Positives that may be exported: executed, correct, with a session."""
    return results.where(F.col("exec_ok") & F.col("correct") & F.col("session_path").isNotNull())


def gold_compared(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results (instance_id, res_hash) with correct: there is a gold_res_hash (instance_id, gold_res_hash) and it is the same."""
    d = results.join(gold.select("instance_id", "gold_res_hash"), "instance_id", "left")
    return d.withColumn("correct", F.coalesce(F.col("res_hash") == F.col("gold_res_hash"), F.lit(False)))


def flattened_tasks(batches: DataFrame, seed: str, limit: int) -> DataFrame:
    """(source, batch, task, place): the tasks of batches (source, batch, tasks), in the order of SHA-256 of seed and source/task, the first `limit`."""
    t = batches.select("source", "batch", F.explode("tasks").alias("task"))
    t = t.withColumn("_key", stable_order_key(seed, F.concat_ws("/", "source", F.col("task").cast("string"))))
    first = t.orderBy("_key", "batch").limit(limit)
    return first.withColumn("place", F.row_number().over(W.orderBy("_key", "batch"))).drop("_key")


def registry_errors(files: DataFrame, connections: DataFrame) -> DataFrame:
    """(database, problem): files (database) without exactly one connection (database, tables) of at least one table, and connections without a file."""
    c = connections.groupBy("database").agg(F.count("*").alias("n"), F.max("tables").alias("tables"))
    d = files.select("database").distinct().withColumn("file", F.lit(True)).join(c, "database", "full")
    problem = F.when(F.col("file").isNull(), "no file").when(F.col("n").isNull(), "no connection").when(F.col("n") > 1, "several connections").when(F.col("tables") < 1, "no tables")
    return d.withColumn("problem", problem).where("problem IS NOT NULL").select("database", "problem")
