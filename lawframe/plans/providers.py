"""Pluggable models: embedders, rerankers and text generators by name, with deterministic offline defaults.

A provider is a plain function; frames see it as an Arrow-batched column. Register others with `register`.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_known: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    """kind: embedder (texts to vectors), generator (prompts to texts) or scorer (pairs to numbers)."""
    _known[kind, name] = make


def provider(kind: str, name: str) -> Callable:
    try:
        return _known[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} named {name!r}") from None


def retried(call: Callable, tries: int = 2, delay: float = 2.0, factor: float = 2.0) -> Callable:
    """`call` again after a delay that grows, at most `tries` times in all."""

    def run(*args):
        wait = delay
        for attempt in range(tries):
            try:
                return call(*args)
            except Exception:
                if attempt == tries - 1:
                    raise
                time.sleep(wait)
                wait *= factor

    return run


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed feature hashing of words, of length one; equal texts have equal vectors."""
    found = []
    for text in texts:
        v = np.zeros(dim)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
            v[h % dim] += 1 if h >> 60 & 1 else -1
        found.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
    return found


def extractive_answer(prompts: list[str], limit: int = 400) -> list[str]:
    """The prompt's last lines, cut: a stand-in for a language model that is the same everywhere."""
    return [p[-limit:] for p in prompts]


def echoed_chat(conversations: list[list[dict]]) -> list[str]:
    """The last message of each conversation, cut: the multi-turn stand-in."""
    return extractive_answer([(c[-1]["content"] or "") if c else "" for c in conversations])


class Embedder:
    """What an embedding model offers: `embed` one text, `batch_embed` many, `vector_dimension`.

    `make` loads the model when it is first used, so that an executor's task loads it once and frames carry only how. A
    batch that fails, and any vector of another dimension, comes back as an empty list; `one_by_one` models are asked
    text by text, and a failure there costs that text alone.
    """

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, one_by_one: bool = False):
        self.make, self.dimension, self.one_by_one, self._model = make, dimension, one_by_one, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def _ask(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            self._model = self.make()
        try:
            found = [flat(v) if len(v) else [] for v in self._model(texts)]
        except Exception:
            return [[] for _ in texts]
        return [v if len(v) == self.dimension else [] for v in found] if len(found) == len(texts) else [[] for _ in texts]

    def batch_embed(self, texts: list[str]) -> list[list[float]]:
        return [self._ask([t])[0] for t in texts] if self.one_by_one else self._ask(texts)

    def embed(self, text: str) -> list[float]:
        return self.batch_embed([text])[0]

    def vector_dimension(self) -> int:
        return self.dimension


def with_fallback(first: Embedder, second: Embedder) -> Embedder:
    """The first model's vectors, and the second's for texts that it has none for."""

    def make():
        def ask(texts: list[str]) -> list[list[float]]:
            found = first.batch_embed(texts)
            left = [i for i, v in enumerate(found) if not v]
            for i, v in zip(left, second.batch_embed([texts[i] for i in left]) if left else [], strict=True):
                found[i] = v
            return found

        return ask

    return Embedder(make, first.vector_dimension())


def flat(vector) -> list[float]:
    """A vector as a list; one of one row (1 x d) loses that row."""
    found = np.asarray(vector, float)
    return (found[0] if found.ndim == 2 and len(found) == 1 else found).tolist()


def local_embedder(config: dict) -> Embedder:
    """A model on the executor's disk: `model_name`, `cache_dir` and `vector_dimension` are needed; `model_name` names a
    registered embedder."""
    missing = [f for f in ("model_name", "cache_dir", "vector_dimension") if f not in config]
    if missing:
        raise ValueError(f"missing in the configuration: {', '.join(missing)}")
    name, dim = config["model_name"], int(config["vector_dimension"])
    call = provider("embedder", name)
    return Embedder(lambda: lambda texts: call(texts, dim), dim)


def http_embedder(url: str, dimension: int, provider_name: str = "local", timeout: float = 60.0, opener: Callable | None = None) -> Embedder:
    """A model behind a service that takes {texts, provider, is_batch} and gives {embeddings}."""

    def make():
        from urllib.request import Request, urlopen

        def ask(texts: list[str]) -> list[list[float]]:
            body = json.dumps({"texts": texts, "provider": provider_name, "is_batch": True}).encode()
            with (opener or urlopen)(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                return json.loads(answer.read())["embeddings"]

        return ask

    return Embedder(make, dimension)


def managed_embedder(call: Callable[[str], list[float]], dimension: int) -> Embedder:
    """A managed service that embeds one text a request."""
    return Embedder(lambda: lambda texts: [call(t) for t in texts], dimension, one_by_one=True)


def embedded(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """`df` with the embedding of a column; empty where there is none. Batches stream through one model a task."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embedder.batch_embed(batch.fillna("").tolist()), index=batch.index, dtype=object)

    return df.withColumn(name, run(F.col(text)))


def embed_request(requests: DataFrame, embedder: Embedder) -> DataFrame:
    """Requests (request_id, texts, is_batch) with status and embeddings, as the service answers: lines of `texts` that
    are not blank are embedded in order; 400 without any, or for other than one unless a batch; 500 if one fails."""
    lines = F.filter(F.transform(F.split(F.coalesce("texts", F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = requests.withColumn("_lines", lines).withColumn("_bad", (F.size("_lines") == 0) | (~F.coalesce("is_batch", F.lit(False)) & (F.size("_lines") != 1)))
    each = rows.select("request_id", "_bad", F.posexplode_outer(F.when(~F.col("_bad"), F.col("_lines"))).alias("_at", "_line"))
    made = embedded(each, "_line", embedder, "_v").groupBy("request_id").agg(F.max("_bad").alias("_bad"), F.min(F.size("_v")).alias("_least"), F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_rows"))
    status = F.when(F.col("_bad"), 400).when(F.col("_least") == 0, 500).otherwise(200)
    return made.select("request_id", status.alias("status"), F.when(status == 200, F.transform("_rows", lambda r: r["_v"])).alias("embeddings"))


register("embedder", "hashed", hashed_embedding)
register("generator", "extractive", extractive_answer)
register("chat", "extractive", echoed_chat)


def embed(text: Column, name: str = "hashed", dim: int = 64) -> Column:
    """array<float> of each text; query texts (under 256 characters) and documents may use different encoders by name."""
    call = provider("embedder", name)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(batch.fillna("").tolist(), dim))

    return run(text)


def embed_auto(text: Column, query: str = "hashed", document: str = "hashed", dim: int = 64) -> Column:
    """Texts under 256 characters by the encoder of queries, others by that of documents."""
    return F.when(F.length(text) < 256, embed(text, query, dim)).otherwise(embed(text, document, dim))


def generate(prompt: Column, name: str = "extractive") -> Column:
    call = retried(provider("generator", name))

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(batch.fillna("").tolist()), dtype=object)

    return run(prompt)


def converse(messages: Column, name: str = "extractive") -> Column:
    """The answer to a conversation, array<struct<role, content>>, of a provider of several turns."""
    call = retried(provider("chat", name))

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call([[] if c is None else [dict(m) for m in c] for c in batch]), dtype=object)

    return run(messages)


def paraphrased(query: Column, name: str = "extractive") -> Column:
    """The question in legal terms, stripped."""
    # Fixed value: the instruction.
    asked = F.concat(F.lit("Viết lại câu hỏi sau đây sử dụng ngôn ngữ, thuật ngữ pháp lý:\n\n"), query)
    return F.regexp_replace(generate(asked, name), r"^\s+|\s+$", "")


def intention_prompt(query: Column, history: Column) -> Column:
    """The question and what was asked before (array<string>), with the form of the answer."""
    before = F.array_join(F.transform(history, lambda h: F.concat(F.lit("User: "), h)), "\n")
    shown = F.when(F.size(F.coalesce(history, F.array().cast("array<string>"))) > 0, before).otherwise("No prior conversation.")
    return F.concat(F.lit("Classify the user's query as irrelevant, history or rag; answer with one JSON object.\n\nConversation History:\n"), shown, F.lit("\n\nUser Query:\n"), query)


def detected_intention(query: Column, history: Column, name: str = "extractive", tries: int = 3) -> Column:
    """struct<intention, response>: the first of `tries` answers that holds an object with a known key, the earliest of
    irrelevant, history and rag; rag without one. The generator hears which try it is."""
    call = provider("generator", name)

    @F.pandas_udf("intention string, response string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        found: list[tuple] = [("rag", None)] * len(prompts)
        left = list(range(len(prompts)))
        for attempt in range(tries):
            if not left:
                break
            try:
                said = call([prompts.iloc[i] if not attempt else f"{prompts.iloc[i]}\n\n(try {attempt + 1})" for i in left])
            except Exception:
                continue
            still = []
            for i, answer in zip(left, said, strict=True):
                known = read_intention(answer)
                if known:
                    found[i] = known
                else:
                    still.append(i)
            left = still
        return pd.DataFrame(found, columns=["intention", "response"])

    return run(F.coalesce(intention_prompt(query, history), F.lit("")))


def read_intention(answer: str | None) -> tuple[str, str | None] | None:
    """What an answer's object, from its first brace to its last, says."""
    text = answer or ""
    begin, end = text.find("{"), text.rfind("}")
    try:
        told = json.loads(text[begin : end + 1]) if 0 <= begin < end else None
    except ValueError:
        return None
    if not isinstance(told, dict):
        return None
    key = next((k for k in ("irrelevant", "history", "rag") if k in told), None)
    if key is None:
        return None
    return key, None if key == "rag" or told[key] is None else told[key] if isinstance(told[key], str) else json.dumps(told[key])
