"""The optional assessment step: prompts, a caller's function under cache, budget and two attempts, results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametide.functions.scalars import RETRYABLE
from frametide.operators import cost
from frametide.operators.records import ASSESSED, BANDS, REQUIRED, SCHEMA_VERSION

PROMPT_VERSION = "clip_v1"
#: A caller's function: (prompt, hint from a failed first attempt or None) -> (JSON text, {"input_tokens", "output_tokens"}).
Call = Callable[[str, str | None], tuple[str, dict]]


def user_prompt(game: Column, index: Column, total: Column, event: Column, note: Column, measured: Column, bands: Column, times: Column) -> Column:
    """The text half of a request: the context, the measured values as ground truth, the tier's ranges, the tiles' times."""
    return F.format_string(
        "Clip %02d of %02d from %s, an engagement of kind %s. Sensitivity: %s.\n\nThese values were measured; take them as given:\n%s\n\nUsual ranges at this level:\n%s\n\nThe picture's tiles were taken at these seconds of the clip: %s.\n\nAnswer in the given schema only.",
        index, total, game, event, note, F.to_json(measured, {"ignoreNullFields": "false"}), F.to_json(bands), F.concat(F.lit("["), F.array_join(F.transform(times, lambda t: F.format_string("%.2f", t)), ", "), F.lit("]")),
    )


def bands_column() -> Column:
    return F.create_map(*[x for m, (lo, hi) in BANDS.items() for x in (F.lit(m), F.array(F.lit(lo), F.lit(hi)))])


class TransportError(Exception):
    """What a caller's function raises for a failed call; ``status_code`` says whether to try again."""

    def __init__(self, message: str, status_code: int = 500):
        super().__init__(message)
        self.status_code = status_code


def attempt(call: Call, prompt: str) -> tuple[str | None, str | None, dict]:
    """(payload, error, usage) after at most two attempts: unusable output is tried again with the error as a hint, transport only if that may help."""
    error = None
    for n in range(2):
        try:
            raw, usage = call(prompt, error if n else None)
            got = json.loads(raw)
            missing = sorted(set(REQUIRED) - set(got)) if isinstance(got, dict) else list(REQUIRED)
            if missing:
                raise ValueError(f"missing required fields: {missing}")
            return json.dumps(got), None, usage or {}
        except (json.JSONDecodeError, ValueError) as e:
            error = str(e)
        except Exception as e:
            error = str(e)
            if getattr(e, "status_code", 500) not in RETRYABLE:
                break
    return None, f"model returned unusable output: {error}", {}


def assess(requests: DataFrame, cache: DataFrame, call: Call, *, budget_key: str, order: list[str], **limits) -> DataFrame:
    """Runs requests (key, prompt, usd) through cache, budget and the caller's function.

    Adds payload, ai_status (cached, ok, failed, skipped), error, input_tokens and
    output_tokens. Only admitted misses are called, in parallel; hits cost nothing.
    """
    found = cost.with_cache(requests, cost.latest_wins(cache))
    hits = found.filter("cached").withColumns({"ai_status": F.lit("cached"), "error": F.lit(None).cast("string"), "input_tokens": F.lit(None).cast("int"), "output_tokens": F.lit(None).cast("int")}).drop("cached")
    asked = cost.admit(found.filter("NOT cached").drop("payload", "cached"), budget_key, order, **limits)
    refused = asked.filter("NOT admitted").select(*requests.columns, F.lit(None).cast("string").alias("payload"), F.lit("skipped").alias("ai_status"), F.col("reason").alias("error"), F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"))
    names = requests.columns
    schema = requests.schema.simpleString()[7:-1] + ",payload:string,ai_status:string,error:string,input_tokens:int,output_tokens:int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [attempt(call, p) for p in pdf["prompt"]]
            yield pdf.assign(payload=[g[0] for g in got], ai_status=["ok" if g[0] else "failed" for g in got], error=[g[1] for g in got], input_tokens=pd.array([g[2].get("input_tokens") for g in got], "Int32"), output_tokens=pd.array([g[2].get("output_tokens") for g in got], "Int32"))

    called = asked.filter("admitted").select(*names).mapInPandas(run, f"struct<{schema}>")
    return hits.unionByName(refused).unionByName(called)


def assessment(payload: Column | str, status: Column | str, error: Column | str) -> Column:
    """An answer as the record's assessed struct; without one, nulls, empty lists and the error as what couldn't be determined."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    got = F.from_json(c(payload), ASSESSED)
    empty = F.array().cast("array<string>")
    why = F.when(c(error).isNotNull(), F.array(c(error))).otherwise(empty)
    fields = {"ai_status": c(status), "evidence": F.coalesce(got["evidence"], F.array().cast("array<struct<t_rel_s:double,observation:string>>")), "not_determinable": F.coalesce(got["not_determinable"], why)}
    order = ("ai_status", "primary_weakness", "severity", "confidence", "summary", "evidence", "drill", "not_determinable")
    return F.struct(*[fields.get(n, got[n]).alias(n) for n in order]).cast(ASSESSED)


def provenance(provider: str, model: Column | str, cv_version: str) -> Column:
    """Who answered, when, and at what price; needs ai_status, input_tokens, output_tokens, usd."""
    m = F.col(model) if isinstance(model, str) else model
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.struct(F.lit(cv_version).alias("cv_version"), F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(provider).alias("provider"), m.alias("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("usd").alias("estimated_cost_usd"), (F.col("ai_status") == "cached").alias("cached"), now.alias("analyzed_at"))


def build_results(answers: DataFrame, provider: str, model: str, cv_version: str) -> DataFrame:
    """Whole records from answers: clip_sha256, file, game, start_ms, end_ms, event_type, measured (struct), usd and what :func:`assess` adds."""
    sha = F.col("clip_sha256")
    rest = F.substring(sha, 33, 32)
    return answers.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.substring(sha, 1, 32).alias("clip_id"),
        F.when(rest == "", F.substring(sha, 1, 32)).otherwise(rest).alias("session_id"),
        F.struct("file", "game", "start_ms", "end_ms", F.lit(60.0).alias("fps"), F.lit("1920x1080").alias("resolution"), sha.alias("content_sha256")).alias("source"),
        F.struct(F.col("event_type").alias("type"), F.lit(None).cast("string").alias("weapon"), F.coalesce(F.col("measured.cv_confidence"), F.lit(0.0)).alias("detection_confidence"), F.array(F.lit("ammo_decrement"), F.lit("kill_feed_ocr")).alias("detected_by")).alias("event"),
        "measured",
        assessment("payload", "ai_status", "error").alias("assessed"),
        provenance(provider, F.lit(model), cv_version).alias("provenance"),
    )
