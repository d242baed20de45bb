"""Seams for models: functions over batches of texts become columns; prompts are assembled natively."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.text import is_noise, vad_reply, word_count
from ..operators.cluster import draw
from ..operators.windows import context_rows, delta, smooth
from ..values import EMOTION_WORDS, EMOTIONS


def batched(fn: Callable[[list[str]], list], kind: str, size: int = 64) -> Callable[[Column], Column]:
    """A model that takes a list of texts, as an Arrow-batched column function; null counts as empty."""
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.fillna("").tolist()
        for at in range(0, len(values), size):
            out += list(fn(values[at : at + size]))
        return pd.Series(out)

    return run


def loaded(load: Callable[[], Callable[[list[str]], list]], kind: str, size: int = 64) -> Callable[[Column], Column]:
    """V1, M4, M5: a model that is loaded once in each worker, not with each batch or query stage, and is given at most
    `size` texts at a time; null counts as empty. kind: a number, or an array of numbers of one length."""
    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()
        return lambda texts: np.array(list(model(["" if t is None else t for t in texts])))

    return predict_batch_udf(make, return_type=DataType.fromDDL(kind), batch_size=size)


def emotion_model(load: Callable[[], Callable[[list[str]], list]], size: int = 64) -> Callable[[Column], Column]:
    """M4: a loaded model that gives a share for each of EMOTIONS, as a struct."""
    shares = loaded(load, "array<double>", size)
    return lambda text: F.transform(F.array(shares(text)), lambda v: F.struct(*[v[i].alias(e) for i, e in enumerate(EMOTIONS)]))[0]


def word_shares() -> Callable[[list[str]], list]:
    """M4: the offline model: shares of emotion words, uniform where there are none."""
    words = [EMOTION_WORDS.get(e, []) for e in EMOTIONS]

    def model(texts: list[str]) -> list:
        out = []
        for t in texts:
            low = t.lower()
            n = [float(sum(w in low for w in ws)) for ws in words]
            out.append([x / sum(n) for x in n] if sum(n) else [1 / len(EMOTIONS)] * len(EMOTIONS))
        return out

    return model


def emotions_by_language(text, language, models: dict[str, Callable[[Column], Column]]) -> Column:
    """M4: each language's own model; uniform where there is none."""
    out = F.struct(*[F.lit(1 / len(EMOTIONS)).alias(e) for e in EMOTIONS])
    for lang, model in models.items():
        out = F.when(F.col(language) == lang, model(F.col(text))).otherwise(out)
    return out


def direct_vad(fn: Callable[[list[str]], list]) -> Callable[[Column], Column]:
    """M5: a model that gives (v, a, d) for each text."""
    return loaded(lambda: lambda texts: [list(map(float, x)) for x in fn(texts)], "array<double>")


def prompted_vad(df: DataFrame, ask: Callable[[str], str], n: int = 5, key: str = "conversation", least: int = 3, most: int = 300, width: int = 3) -> DataFrame:
    """Each own text with the n messages before it goes to a model, which is asked once more where its
    reply holds no values; then changes and smoothed values per conversation. The first message of a conversation,
    short ones and noise are no targets."""
    line = lambda s: F.concat_ws(": ", s["sender_name"], F.substring(s["text"], 1, most))
    x = df.withColumn("before", context_rows(["sender_name", "text"], key, n, "date", "ord")).filter(F.size("before") > 0)
    x = x.filter((word_count("text") >= least) & ~is_noise("text"))
    prompt = F.concat(F.lit("Give valence, arousal and dominance of the last message as JSON with v, a, d.\n"), F.array_join(F.transform("before", line), "\n"), F.lit("\n> "), F.substring("text", 1, most))

    def reply(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            r = ask(p) or ""
            out.append(r if "{" in r else ask(p) or "")
        return out

    x = x.withColumn("vad", vad_reply(batched(reply, "string")(prompt))).select(key, "date", "ord", "text", "vad.*")
    return x.select("*", *[delta(c, key, "date", "ord").alias(f"d{c}") for c in "vad"], *[smooth(c, key, width, "date", "ord").alias(f"s{c}") for c in "vad"])


def persona_prompts(df: DataFrame, label: str, id_: str, samples: int = 25, most: int = 300) -> DataFrame:
    """M9: a prompt per cluster: its three strongest emotions and a fixed sample of texts, shortened."""
    strong = df.groupBy(label).agg(*[F.avg(e).alias(e) for e in EMOTIONS]).select(label, F.slice(F.transform(F.reverse(F.array_sort(F.array(*[F.struct(F.col(e).alias("p"), F.lit(e).alias("e")) for e in EMOTIONS]))), lambda s: s["e"]), 1, 3).alias("top"))
    w = Window.partitionBy(label).orderBy(draw(id_), id_)
    some = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
    texts = some.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, most).alias("t")))), lambda s: F.concat(F.lit("- "), s["t"])), "\n").alias("texts"))
    return strong.join(texts, label).select(label, F.concat(F.lit("Describe the person who writes like this; mostly "), F.array_join("top", ", "), F.lit(".\n"), "texts").alias("prompt"))
