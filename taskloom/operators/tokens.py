"""Token arrays of conversations, with labels on what an assistant says."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of a turn's begin and end, and the label of a token that counts in no loss.
START, END, IGNORED = "<|im_start|>", "<|im_end|>", -100
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_of(content: str):
    """A byte-level tokenizer from its file's content, with START and END as tokens of their own behind its vocabulary; their strings in texts are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.add_special_tokens([START, END])
    t.encode_special_tokens = True
    return t


def labelled(messages: list[tuple[str, str]], tokenizer, most: int | None = None) -> tuple[list[int], list[int]]:
    """(ids, labels) of one conversation's (role, text), as START role newline text END newline each.

    A label is the token's id from the first sign of an assistant's text that is no newline up to and with END, IGNORED elsewhere. A token
    belongs to the text if it ends behind that sign's place, by its offsets into what was rendered. At most `most` tokens are kept.
    """
    start, end = tokenizer.token_to_id(START), tokenizer.token_to_id(END)
    gap = tokenizer.encode("\n", add_special_tokens=False).ids
    ids: list[int] = []
    labels: list[int] = []
    for role, text in messages:
        head = f"{role}\n"
        e = tokenizer.encode(head + text, add_special_tokens=False)
        said = role == "assistant"
        at = len(head) + len(text) - len(text.lstrip("\n"))
        ids += [start, *e.ids, end, *gap]
        labels += [IGNORED, *(i if said and b > at else IGNORED for i, (_, b) in zip(e.ids, e.offsets, strict=True)), end if said else IGNORED, *[IGNORED] * len(gap)]
    return ids[:most], labels[:most]


def _small_batches(spark: SparkSession) -> None:
    """Python workers get Arrow batches of 2 MB at most, where the session has Spark's own default of 64 MB; the setting stays, as results are computed later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, "2m")


def token_labels(conversations: DataFrame, tokenizer_path: str | None = None, most: int | None = None) -> DataFrame:
    """(conv_id, input_ids, labels): labelled() of conversations (conv_id, messages array<struct<role, text>>), in the order of the array.

    Null roles and texts are empty; a conversation without messages has no tokens. The driver reads the tokenizer's file and sends it to the
    executors. A conversation is one row, and is worked on whole.
    """
    _small_batches(conversations.sparkSession)
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        sent = conversations.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("struct<input_ids:array<int>,labels:array<int>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = cache(lambda: tokenizer_of(sent.value))
        for rows in batches:
            # numbers of four bytes, a conversation at a time: lists of Python's numbers take some twenty times as much
            found = [[np.array(x, np.int32) for x in labelled([(m["role"] or "", m["text"] or "") for m in (r if r is not None else ())], tokenizer(), most)] for r in rows]
            yield pd.DataFrame({"input_ids": [f[0] for f in found], "labels": [f[1] for f in found]})

    return conversations.select("conv_id", label("messages").alias("x")).select("conv_id", "x.input_ids", "x.labels")


def labelled_texts(labels: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, texts): what the labels of token_labels() say, one text for each END among them; tokens behind the last END make a text that was cut."""
    _small_batches(labels.sparkSession)
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        sent = labels.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = cache(lambda: tokenizer_of(sent.value))
        for rows in batches:
            out = []
            for row in rows:
                texts, held, end = [], [], tokenizer().token_to_id(END)
                for i in row:
                    if i == end:
                        texts.append(tokenizer().decode(held, skip_special_tokens=False))
                        held = []
                    elif i != IGNORED:
                        held.append(int(i))
                out.append(texts + [tokenizer().decode(held, skip_special_tokens=False)] * bool(held))
            yield pd.Series(out)

    return labels.select("conv_id", read("labels").alias("texts"))
