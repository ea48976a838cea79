"""The dataflow around a paid assessment step: cost, admission, rate, cache, outcome. The step itself is a function that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frametide.functions.scalars import OUTPUT_TOKENS, cost_usd
from frametide.operators.folds import ordered_fold

SESSION_USD, MONTH_USD = 0.50, 10.00
RATE_PER_S, BURST = 8 / 60, 3.0


def price_requests(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds rate_in, rate_out, output_tokens, usd; a model without a price costs 0. ``prices`` has one row a model and is broadcast."""
    dim = F.broadcast(prices.select("model", F.col("input").alias("rate_in"), F.col("output").alias("rate_out")))
    joined = requests.join(dim, "model", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("rate_in", "rate_out")})
    return joined.withColumns({"output_tokens": F.lit(OUTPUT_TOKENS), "usd": cost_usd("input_tokens", "rate_in", "rate_out")})


def admit(requests: DataFrame, key: str, order: list[str], *, session: str | None = None, session_usd: float = SESSION_USD, month_usd: float = MONTH_USD) -> DataFrame:
    """Adds admitted, reason and spent_before: in order, a request is refused if it would pass a limit, and then costs nothing, so that a later, cheaper one may pass.

    ``key`` has one budget of ``month_usd``; within it each ``session`` has one of
    ``session_usd``. Not a running sum: each decision needs the one before, so a
    budget's requests pass one task, as a sorted stream; held are a number a
    budget and one a session.
    """

    def budget():
        month, by_session = 0.0, {}

        def step(usd: float, part: object = None) -> tuple:
            nonlocal month
            spent = by_session.get(part, 0.0)
            reason = "session limit" if spent + usd > session_usd else "month limit" if month + usd > month_usd else None
            if reason is None:
                by_session[part] = spent + usd
                month += usd
            return reason is None, reason, spent

        return step

    return ordered_fold(requests, key, order, ["usd", session] if session else ["usd"], "admitted boolean, reason string, spent_before double", budget)


def token_bucket(arrivals: DataFrame, key: str, at: str, order: list[str], *, rate: float = RATE_PER_S, burst: float = BURST) -> DataFrame:
    """Adds wait_s and tokens_left: how long each arrival waits for a bucket that refills at ``rate`` up to ``burst``.

    Arrivals are served in order; ``at`` is in seconds. A bucket's arrivals pass
    one task, as a sorted stream; held are two numbers a bucket.
    """

    def bucket():
        tokens, now = burst, None

        def step(t: float) -> tuple:
            nonlocal tokens, now
            start = t if now is None else max(t, now)
            tokens = burst if now is None else min(burst, tokens + (start - now) * rate)
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens = tokens + wait * rate - 1
            now = start + wait
            return now - t, tokens

        return step

    return ordered_fold(arrivals, key, order, [at], "wait_s double, tokens_left double", bucket)


def model_defaults(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Fills a null model by provider and tier ("clip" by default). ``models`` has one row for each (provider, tier, model) and is broadcast; an unknown provider fails, naming those there are."""
    named = ", ".join(sorted(r["provider"] for r in models.select("provider").distinct().collect()))  # a handful by contract
    dim = F.broadcast(models.select("provider", F.col("tier").alias("_tier"), F.col("model").alias("_model")))
    tier = F.coalesce(F.col("tier"), F.lit("clip")) if "tier" in requests.columns else F.lit("clip")
    asked = requests.withColumn("_tier", tier)
    found = F.coalesce(F.col("model"), F.col("_model")) if "model" in requests.columns else F.col("_model")
    wrong = F.raise_error(F.concat(F.lit("unknown provider "), F.coalesce("provider", F.lit("null")), F.lit(f"; expected one of {named}")))
    return asked.join(dim, ["provider", "_tier"], "left").withColumn("model", F.when(F.col("_model").isNull(), wrong).otherwise(found)).drop("_model", "_tier")


def request_defaults(requests: DataFrame) -> DataFrame:
    """Fills what a request may leave out: session_usd, month_usd, rate_per_s, burst. A null or blank api_key fails, naming its provider."""
    given = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in requests.columns else F.lit(d)
    filled = requests.withColumns({c: given(c, d) for c, d in {"session_usd": SESSION_USD, "month_usd": MONTH_USD, "rate_per_s": RATE_PER_S, "burst": BURST}.items()})
    missing = F.coalesce(F.trim("api_key"), F.lit("")) == ""
    return filled.withColumn("api_key", F.when(missing, F.raise_error(F.concat(F.lit("no API key configured for "), F.col("provider")))).otherwise(F.col("api_key")))


def valid_keys(keys: DataFrame, probe: Callable[[str, str], object]) -> DataFrame:
    """Adds valid to rows of provider and api_key: whether ``probe(provider, api_key)``, the caller's cheapest call, returns without failing."""

    def works(provider: str, key: str) -> bool:
        try:
            probe(provider, key)
        except Exception:  # whatever goes wrong, the key can't be used
            return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [works(p, k) for p, k in zip(batch.column("provider").to_pylist(), batch.column("api_key").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*batch.schema.names, "valid"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("valid", T.BooleanType())]))


def latest_wins(cache: DataFrame, key: str = "key", at: str = "created_at", tie: str = "payload") -> DataFrame:
    """One row a key: the latest, as an upsert leaves it."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return cache.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds payload and cached; ``cache`` has one row a key."""
    hits = cache.select("key", "payload")
    return requests.join(hits, "key", "left").withColumn("cached", F.col("payload").isNotNull())


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def outcome(cached: Column | str, admitted: Column | str, missing: Column | str, attempts: Column | str, transport_status: Column | str) -> Column:
    """How a request ends: cached, skipped (refused), failed or ok, over at most two attempts."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    bad = (F.size(c(missing)) > 0) | F.coalesce(c(transport_status) >= 400, F.lit(False)) | (c(attempts) > 2)
    return F.when(c(cached), "cached").when(~c(admitted), "skipped").when(bad, "failed").otherwise("ok")
