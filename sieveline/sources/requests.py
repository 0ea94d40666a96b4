"""Requests, streamed answers and devices as rows: what a server or a client reads off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields taken from JSON bodies, the end mark of a stream, and connections on which downloads wait.
FIELDS = ("text", "SpeechResult", "Digits", "From", "CallSid", "Language", "lang")
DONE = "[DONE]"
SLOW = ("2g", "slow-2g")


def read_inputs(content_type: Column, body: Column) -> Column:
    """map of a request's fields: those of FIELDS from a JSON body, all of a form, or `text` for any other body."""
    kind = F.coalesce(content_type, F.lit(""))
    parsed = F.from_json(body, "map<string,string>")
    known = F.coalesce(F.map_filter(parsed, lambda k, _: k.isin(*FIELDS)), F.expr("cast(map() as map<string,string>)"))
    pairs = F.transform(F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda p: p != ""), lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.url_decode(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))).otherwise("").alias("v")))
    last = F.filter(pairs, lambda p: p["k"].isNotNull())
    form = F.map_from_entries(F.filter(F.transform(last, lambda p, i: F.when(~F.exists(F.slice(last, i + 2, F.size(last)), lambda o: o["k"] == p["k"]), p)), lambda p: p.isNotNull()))
    return F.when(F.contains(kind, F.lit("application/json")), known).when(F.contains(kind, F.lit("form")), form).otherwise(F.create_map(F.lit("text"), F.coalesce(body, F.lit(""))))


def stream_tokens(chunks: DataFrame, key: str) -> DataFrame:
    """key, seq, token: the contents of a stream's data lines, whose text comes in chunks (key, seq, chunk) cut anywhere.

    A line ends in the chunk that holds its line end; a window over the stream's chunks gives each the rest that the ones before
    it left open, so that no stream is gathered whole. What follows the last line end is no line. Lines of another kind, the
    end mark and contents that cannot be parsed give nothing.
    """
    w = Window.partitionBy(key).orderBy("seq")
    has_end = F.contains("chunk", F.lit("\n"))
    rows = chunks.withColumn("_ends", F.sum(F.when(has_end, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_ends", F.coalesce("_ends", F.lit(0)))
    # chunks between two line ends belong to the chunk with the next one; its first line starts with their text
    open_text = F.when(has_end, F.substring_index("chunk", "\n", -1)).otherwise(F.col("chunk"))
    opened = rows.select(key, F.when(has_end, F.col("_ends") + 1).otherwise(F.col("_ends")).alias("_ends"), "seq", open_text.alias("_o"))
    before = opened.groupBy(key, "_ends").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_o"))), lambda x: x["_o"]), "").alias("_before"))
    full = rows.where(has_end).join(before, [key, "_ends"], "left")
    lines = F.split(F.concat(F.coalesce("_before", F.lit("")), F.col("chunk")), "\n")
    each = full.select(key, "seq", F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("i", "line")).where(F.startswith("line", F.lit("data:")))
    data = F.trim(F.substring("line", 6, 1 << 30))
    token = F.get_json_object(data, "$.choices[0].delta.content")
    return each.where(data != DONE).select(key, "seq", "i", token.alias("token")).where("token <> ''")


def first_answer(attempts: DataFrame, key: str, fallback: Column) -> DataFrame:
    """key, answer, source: the first attempt (key, ord, provider, status, body) of status 200, else the deterministic fallback."""
    best = attempts.groupBy(key).agg(F.min_by(F.struct("provider", "body"), F.when(F.col("status") == 200, F.col("ord"))).alias("_b"))
    return best.select(key, F.coalesce("_b.body", fallback).alias("answer"), F.coalesce("_b.provider", F.lit("deterministic-fallback")).alias("source"))


def resolve_base(base: Column, origin: Column) -> Column:
    """A model folder's address: absolute ones and other schemes as they are without slashes at the end, paths under the origin."""
    b = F.regexp_replace(F.trim(F.coalesce(base, F.lit(""))), "/+$", "")
    path = F.when(F.startswith(b, F.lit("/")), b).otherwise(F.concat(F.lit("/"), b))
    return F.when(b == "", "").when(b.rlike("(?i)^[a-z][a-z0-9+.-]*:"), b).otherwise(F.concat(F.regexp_extract(origin, "^[a-z]+://[^/]+", 0), path))


def defer_reason(save_data: Column, connection: Column) -> Column:
    return F.when(save_data, "Data Saver is on").when(connection.isin(*SLOW), F.concat(F.lit("connection is "), connection))


def device_profile(memory: Column, threads: Column, webgpu: Column, isolated: Column) -> Column:
    """struct(profile, backend, budget, threads) of a device; unknown memory counts as 4 GB."""
    m = F.coalesce(memory, F.lit(4.0))
    profile = F.when((m >= 8) & (threads >= 8), "flagship").when((m <= 2) | (threads <= 2), "minimal").when((m <= 3) | (threads <= 4), "low").otherwise("mid")
    backend = F.when((profile == "minimal") & (m < 2), "tier0-only").when(webgpu & (profile != "minimal"), "webgpu").when(isolated & (threads > 2), "wasm-mt").otherwise("wasm-st")
    budget = F.when(profile == "low", 1).when(profile == "minimal", 0).otherwise(3)
    return F.struct(profile.alias("profile"), backend.alias("backend"), budget.alias("budget"), F.when(backend == "wasm-mt", F.greatest(F.lit(1), F.least(F.lit(4), threads - 1))).otherwise(1).alias("threads"))


def voices_for(wanted: DataFrame, voices: DataFrame, key: str) -> DataFrame:
    """key, name, rank: the voices (name, lang, local, ord) of each wanted language (key, lang): exact ones, local first; else those of its base."""
    base = F.lower(F.substring_index("lang", "-", 1))
    both = wanted.select(key, F.lower("lang").alias("_l"), base.alias("_b")).join(voices.select("name", F.lower("lang").alias("_v"), F.lower(F.substring_index("lang", "-", 1)).alias("_b"), "local", "ord"), "_b")
    exact = F.col("_l") == F.col("_v")
    marked = both.withColumn("_x", exact).withColumn("_any", F.max(exact.cast("int")).over(Window.partitionBy(key)))
    order = Window.partitionBy(key).orderBy(F.when(F.col("_any") == 1, ~F.col("local")), "ord")
    return marked.where((F.col("_any") == 0) | F.col("_x")).select(key, "name", F.row_number().over(order).alias("rank"))


def model_states(events: DataFrame, key: str) -> DataFrame:
    """events (key, seq, event) with `state`, that of the model after each one: idle until a known event comes.

    An error or a deferral ends a load until the next probe; events that say nothing of the state keep it.
    """
    known = {"probe": "probing", "download": "downloading", "loaded": "ready", "missing": "unpublished", "fail": "error", "defer": "deferred", "reset": "idle"}
    state = F.lit(None).cast("string")
    for e, s in known.items():
        state = F.when(F.col("event") == e, s).otherwise(state)
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("state", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit("idle")))
