"""Text embeddings and pair scores: a built-in stand-in and model plug-ins."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.config import EmbedderConfig
from labelwright.fixed.limits import EMBEDDING_DIM

# An embedder turns a text column into an array<float> column.
Embedder = Callable[[Column], Column]


def codepoint_embedder(dim: int = EMBEDDING_DIM) -> Embedder:
    """Stand-in embedding: the text's code points summed, modulo 100, over 100, repeated."""

    def embed(text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        total = F.aggregate(chars, F.lit(0).cast("bigint"), lambda s, c: s + F.ascii(c))
        return F.array_repeat(((total % 100) / F.lit(100.0)).cast("float"), dim)

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], object]]) -> Embedder:
    """Embedder around a model; ``load`` runs once per Python worker and returns a batch encoder."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return lambda text: embed(text)


def sentence_model(config: EmbedderConfig = EmbedderConfig()) -> Embedder:
    """The default sentence model; needs the sentence-transformers package on the workers."""

    def load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(config.model_name)
        return lambda texts: model.encode(texts, batch_size=config.batch_size, convert_to_numpy=True)

    return model_embedder(load)


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], object]]) -> Callable[[Column, Column], Column]:
    """Neural score of (query, context) pairs; without a model candidates score 0."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for left, right in batches:
            yield pd.Series([float(x) for x in predict(list(zip(left, right)))])

    return lambda query, context: score(query, context)


def cross_encoder(model_name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2") -> Callable[[Column, Column], Column]:
    def load():
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(model_name)
        return lambda pairs: model.predict([list(p) for p in pairs])

    return pair_scorer(load)


def pair_context(query: Column, intent: Column) -> Column:
    """Text a candidate is paired with; expects the candidate's chunk columns in the row."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    requirement = F.coalesce(F.nullif(intent["requirement_name"], F.lit("")), F.lit("Legal Metrology Provision"))
    provision = F.concat(
        F.lit("Rule "), shown("rule"), F.lit(" (Sub "), shown("sub_rule"), F.lit(", Clause "), shown("clause"),
        F.lit(", Schedule "), shown("schedule"), F.lit(")"))
    return F.concat_ws(
        "\n",
        line("QUERY", query),
        line("INTENT", F.coalesce(intent["intent_id"], F.lit("None"))),
        line("FACETS", F.array_join(intent["detected_facets"], ", ")),
        line("CONTEXT", intent["detected_context"]),
        line("REQUIREMENT", requirement),
        line("PROVISION", provision),
        line("DOCUMENT", F.lit("Legal Metrology (Packaged Commodities) Rules, 2011")),
        line("TEXT", F.col("text")),
    )
