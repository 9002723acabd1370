"""Model passes: requests as prompt rows, replies as canned text in, rows out.

A model is a registered function from prompts to replies; without one every reply is null
and documents keep their pattern entities.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CLASSES, MERGED_VERSION, PATTERN_VERSION, PREDICATES
from . import extract as X

REFINED = (
    "refined_entities array<struct<pass1_id:string,class:string,subclass:string,confidence:float>>, "
    "additional_entities array<struct<value:string,class:string,subclass:string,confidence:float>>, topic string, tags array<string>, language string"
)
RELATIONS = "triples array<struct<subject:string,predicate:string,object:string>>, new_predicates array<struct<name:string,description:string>>"
LABEL = "label string, description string"
_MODELS: dict[str, Callable[[list[str]], list[str | None]]] = {}
#: Temperature and token limit of each request.
SETTINGS = {"refine": (0.0, 4096), "relations": (0.0, 2048), "label": (0.3, 256), "bootstrap": (0.2, 2048)}


def register_llm(model: Callable[[list[str]], list[str | None]] | None, name: str = "default") -> None:
    if model is None:
        _MODELS.pop(name, None)
    else:
        _MODELS[name] = model


def ask(prompts: DataFrame, column: str = "prompt", out: str = "reply", name: str = "default", attempts: int = 3) -> DataFrame:
    """Prompts with replies; a batch that fails is tried again, then its replies are null."""
    model = _MODELS.get(name)
    if model is None:
        return prompts.withColumn(out, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import time

        for attempt in range(attempts):
            try:
                return pd.Series(model(texts.tolist()))
            except Exception:  # a provider's own errors
                if attempt + 1 < attempts:
                    time.sleep(2**attempt)
        return pd.Series([None] * len(texts))

    return prompts.withColumn(out, run(F.col(column)))


def refine_prompt(text: Column, entities: Column) -> Column:
    """The clipped text and its entities as `e_N: value (class=, subclass=)`."""
    lines = F.transform(entities, lambda e, i: F.concat(F.lit("e_"), i, F.lit(": "), e["value"], F.lit(" (class="), F.coalesce(e["class"], F.lit("")), F.lit(", subclass="), F.coalesce(e["subclass"], F.lit("")), F.lit(")")))
    return F.concat(F.lit("Classes: " + ", ".join(CLASSES) + "\nEntities:\n"), F.array_join(lines, "\n"), F.lit("\nText:\n"), T.clip_head_tail(text))


def relation_prompt(text: Column, entities: Column, vocabulary: tuple[str, ...] = PREDICATES) -> Column:
    return F.concat(F.lit("Predicates: " + ", ".join(vocabulary) + "\n"), refine_prompt(text, entities))


def label_prompt(titles: Column, classes: Column, topics: Column, avoid: Column) -> Column:
    parts = {"Files": titles, "Entities": classes, "Topics": topics, "Avoid": avoid}
    clean = {k: F.array_join(F.transform(v, lambda x: T.sanitize_field(x)), "; ") for k, v in parts.items()}
    return F.concat(*[x for k, v in clean.items() for x in (F.lit(f"{k}: "), v, F.lit("\n"))])


def bootstrap_prompt(samples: DataFrame, n: int = 30, entities: int = 5) -> DataFrame:
    """One prompt row over the first n samples (doc_id, title, topic, tags, extracted_entities): a line each, with its first entities."""
    named = F.array_join(F.transform(F.slice("extracted_entities", 1, entities), lambda e: F.concat(F.coalesce(e["class"], e["entity_type"]), F.lit(":"), e["value"])), ", ")
    line = F.concat_ws(" | ", "title", "topic", F.array_join("tags", ","), named)
    first = samples.orderBy("doc_id").limit(n)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def two_pass(docs: DataFrame, reply: str = "reply", enabled: bool = True) -> DataFrame:
    """Documents with the reply's entities merged in (version 3.0), or their pattern entities alone (2.5).

    Entities keep all their fields and get short names; the reply's topic and tags are normalised.  A reply that is
    null or no JSON, or a model that is switched off, leaves the pattern entities.
    """
    parsed = T.parse_json_reply(F.col(reply), REFINED) if enabled else F.from_json(F.lit(None).cast("string"), REFINED)

    @F.pandas_udf(X.ENTITIES)
    def merged(first: pd.Series, answer: pd.Series) -> pd.Series:
        def one(entities: str | None, given: str | None) -> list[dict]:
            found = json.loads(entities or "[]")
            found = [{name: e.get(name) for name in X.ENTITY.names} for e in found]
            if given is None:
                return found
            said = json.loads(given)
            return X.merge_passes(found, said.get("refined_entities") or [], said.get("additional_entities") or [])

        return pd.Series([one(a, b) for a, b in zip(first, answer, strict=True)])

    out = docs.withColumn("_p", parsed)
    good = F.col("_p").isNotNull()
    entities = merged(F.to_json("extracted_entities"), F.to_json("_p"))
    short = F.transform("_e", lambda e: e.withField("canonical_short_name", T.short_name(e["value"], F.coalesce(e["class"], F.lit("")))))
    tags = F.filter(F.transform(F.col("_p.tags"), T.normalize_tag), lambda x: x != "")
    return out.withColumn("_e", entities).select(
        *[c for c in docs.columns if c not in ("extracted_entities", reply)], short.alias("extracted_entities"),
        F.when(good, F.nullif(T.normalize_tag(F.col("_p.topic")), F.lit(""))).alias("topic"),
        F.coalesce(F.when(good, tags), F.array().cast("array<string>")).alias("tags"), F.when(good, F.col("_p.language")).alias("language"),
        F.when(good, MERGED_VERSION).otherwise(PATTERN_VERSION).alias("entities_version"),
    )


def relations(docs: DataFrame, reply: str = "reply") -> DataFrame:
    """(doc_id, s, predicate, o): a reply's triples between entities named e_N, by position."""
    parsed = docs.select("doc_id", F.explode(T.parse_json_reply(F.col(reply), RELATIONS)["triples"]).alias("t"))
    position = lambda c: F.regexp_extract(c, "^e_([0-9]+)$", 1).try_cast("int")
    return parsed.select("doc_id", position(F.col("t.subject")).alias("s"), F.col("t.predicate").alias("predicate"), position(F.col("t.object")).alias("o")).where("s is not null and o is not null")


#: What the frames of each provider hold, as far as it is read.
_USAGE = "struct<input_tokens:long,output_tokens:long,prompt_tokens:long,completion_tokens:long>"
FRAMES = {
    "anthropic": f"type string, delta struct<type:string,text:string>, message struct<model:string,usage:{_USAGE}>, usage {_USAGE}, error struct<message:string>",
    "openai": f"model string, choices array<struct<delta:struct<content:string>>>, usage {_USAGE}",
    "codex": f"type string, delta string, response struct<model:string,usage:{_USAGE},error:struct<message:string>>, usage {_USAGE}, error struct<message:string>",
    "gemini": "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>, usageMetadata struct<promptTokenCount:long,candidatesTokenCount:long>",
    "ollama": "message struct<content:string>, done boolean, model string, prompt_eval_count long, eval_count long",
}


def _frame(provider: str, j: Column, event: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """Token, end, error message, tokens in and out, and model of a frame, as far as it tells them."""
    none = F.lit(None)
    if provider == "anthropic":
        kind = F.coalesce(event, j["type"])
        token = F.when((kind == "content_block_delta") & (j["delta"]["type"] == "text_delta"), j["delta"]["text"])
        usage_in = F.when(kind == "message_start", j["message"]["usage"]["input_tokens"]).when(kind == "message_delta", j["usage"]["input_tokens"])
        error = F.when(kind == "error", F.coalesce(j["error"]["message"], F.lit("stream error")))
        return token, kind == "message_stop", error, usage_in, F.when(kind == "message_delta", j["usage"]["output_tokens"]), F.when(kind == "message_start", j["message"]["model"])
    if provider == "openai":
        token = F.nullif(F.get(j["choices"], F.lit(0))["delta"]["content"], F.lit(""))
        return token, j["usage"].isNotNull(), none, j["usage"]["prompt_tokens"], j["usage"]["completion_tokens"], j["model"]
    if provider == "codex":
        kind, usage = F.coalesce(event, j["type"]), lambda name: F.coalesce(j["response"]["usage"][name], j["usage"][name])
        error = F.when(kind == "response.failed", F.coalesce(j["response"]["error"]["message"], j["error"]["message"], F.lit("stream failed")))
        return F.when(kind == "response.output_text.delta", j["delta"]), kind == "response.completed", error, usage("input_tokens"), usage("output_tokens"), j["response"]["model"]
    if provider == "gemini":
        token = F.nullif(F.get(F.get(j["candidates"], F.lit(0))["content"]["parts"], F.lit(0))["text"], F.lit(""))
        return token, j["usageMetadata"].isNotNull(), none, j["usageMetadata"]["promptTokenCount"], j["usageMetadata"]["candidatesTokenCount"], none
    return F.nullif(j["message"]["content"], F.lit("")), F.coalesce(j["done"], F.lit(False)), none, j["prompt_eval_count"], j["eval_count"], j["model"]


def stream_frames(frames: DataFrame, provider: str = "openai") -> DataFrame:
    """(message_id, seq, kind, token, message, cumulative_index, input_tokens, output_tokens, model) of a provider's frames.

    `frames` (message_id, seq, line) holds server-sent frames (`event:` and `data:` lines, of which several data lines
    are joined) or JSON lines.  What is no JSON is left out.  A frame may give a token and the end; `cumulative_index`
    counts the tokens so far, usage and model are the last that were told.
    """
    data = F.array_join(F.transform(F.regexp_extract_all("line", F.lit(r"(?m)^data:(.*)$"), F.lit(1)), F.trim), "\n")
    body = F.trim(F.when(F.col("line").rlike(r"(?m)^data:"), data).otherwise(F.col("line")))
    event = F.nullif(F.trim(F.regexp_extract("line", r"(?m)^event:(.*)$", 1)), F.lit(""))
    parsed = frames.withColumn("_j", F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, FRAMES[provider]))).where("_j is not null")
    token, done, error, used, made, model = _frame(provider, F.col("_j"), event)
    told = [used.cast("long").alias("input_tokens"), made.cast("long").alias("output_tokens"), model.cast("string").alias("model")]
    parts = F.array(
        F.struct(F.lit(0).alias("n"), F.when(token.isNotNull(), "token").alias("kind"), token.alias("token"), F.lit(None).cast("string").alias("message")),
        F.struct(F.lit(1).alias("n"), F.when(error.isNotNull(), "error").when(done, "done").alias("kind"), F.lit(None).cast("string").alias("token"), error.cast("string").alias("message")),
    )
    rows = parsed.select("message_id", "seq", *told, F.explode(parts).alias("p")).select("message_id", "seq", "input_tokens", "output_tokens", "model", "p.*")
    w = Window.partitionBy("message_id").orderBy("seq", "n")
    counted = rows.withColumn("cumulative_index", F.sum(F.when(F.col("kind") == "token", 1).otherwise(0)).over(w))
    latest = {c: F.last(c, ignorenulls=True).over(w) for c in ("input_tokens", "output_tokens", "model")}
    out = counted.withColumns(latest).where("kind is not null")
    return out.select("message_id", "seq", "kind", "token", "message", "cumulative_index", "input_tokens", "output_tokens", "model")
