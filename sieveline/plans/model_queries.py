"""Queries over logits taken from embeddings: decoding, calibration, evaluation; and over corpora: splits, windows, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from ..operators import calibrate, dataset, evals, vocabulary, windows
from ..sources import dimensions as dim


def _scored(spark, d) -> DataFrame:
    """Stand-in logits: the first k (2, 4, 8 or 12) components of each vector, times 8; the label modulo k is right."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    k = F.element_at(F.array(*map(F.lit, (2, 4, 8, 12))), (F.pmod("vec_id", F.lit(4)) + 1).cast("int"))
    logits = F.transform(F.slice("embedding", F.lit(1), F.col("k")), lambda x: x.cast("double") * 8)
    return e.withColumn("k", k).select("vec_id", "k", logits.alias("logits"), F.pmod("label", F.col("k")).alias("gold"))


_L = "l AS (SELECT vec_id, k, list_transform(embedding[1:k], lambda x: x::DOUBLE * 8) AS z, label % k AS gold FROM (SELECT *, [2, 4, 8, 12][vec_id % 4 + 1] AS k FROM embeddings))"
_P = f"""{_L}, x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM l),
p AS (SELECT vec_id, k, gold, z, list_transform(e, lambda v: v / list_sum(e)) AS p, CASE k WHEN 2 THEN 'choice:2' WHEN 4 THEN 'choice:3-5' WHEN 8 THEN 'choice:6-10' ELSE 'choice:11+' END AS bucket FROM x),
c AS (SELECT *, list_max(p) AS conf, (list_position(p, list_max(p)) - 1 = gold)::INTEGER AS correct FROM p)"""


def _confidence(spark, d) -> DataFrame:
    rows = _scored(spark, d).withColumn("p", decode.softmax(F.col("logits")))
    rows = rows.withColumns({"conf": decode.max_confidence(F.col("p")), "entropy": decode.entropy_confidence(F.col("p")), "bucket": decode.bucket(F.lit("choice"), F.col("k"))})
    return rows.withColumn("correct", (decode.argmax(F.col("p")) == F.col("gold")).cast("int"))


def softmax_decode(spark, d):
    return _scored(spark, d).select("vec_id", F.posexplode(decode.softmax(F.col("logits"))).alias("option", "p")).select("vec_id", "option", F.round("p", 9).alias("p"))


def entropy_confidence(spark, d):
    return _confidence(spark, d).select("vec_id", F.round("entropy", 8).alias("entropy"), F.round("conf", 8).alias("conf"))


def unpermute(spark, d):
    order = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.pmod(i + 1, F.col("k")))
    p = decode.unpermute(decode.softmax(F.col("logits")), order)
    return _scored(spark, d).select("vec_id", F.posexplode(p).alias("option", "p")).select("vec_id", "option", F.round("p", 9).alias("p"))


def abstain_flags(spark, d):
    cuts = F.create_map(F.lit("choice:2"), F.lit(0.4), F.lit("choice:6-10"), F.lit(0.15))
    rows = _confidence(spark, d).withColumn("cut", decode.abstain_for(cuts, F.lit("choice"), F.col("k")))
    return rows.select("bucket", "cut", (F.col("entropy") < F.col("cut")).alias("abstained")).groupBy("bucket", "cut", "abstained").agg(F.count(F.lit(1)).alias("n"))


def bucket_lookup(spark, d):
    temps = F.create_map(F.lit("choice:2"), F.lit(2.5), F.lit("default"), F.lit(1.5), F.lit("choice:11+"), F.lit(-1.0))
    rows = _scored(spark, d).select("k", decode.temperature_for(temps, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.lit("choice"), F.col("k")).alias("t"))
    return rows.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))


_GRID = [round(0.5 + 0.25 * i, 2) for i in range(19)]


def temperature_grid_fit(spark, d):
    rows = _confidence(spark, d).withColumn("target", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(i == F.col("gold"), 1.0).otherwise(0.0)))
    return calibrate.fit_temperatures(calibrate.records(rows.select("bucket", "logits", "target")), "bucket", _GRID, 30).select("bucket", "temperature", F.round("loss", 6).alias("loss"))


_FIT = f"""WITH {_P}, t AS (SELECT bucket, t, avg(ln(list_sum(list_transform(z, lambda v: exp(v / t - list_max(z) / t)))) + list_max(z) / t - z[gold + 1] / t) AS loss, count(*) AS n
  FROM p, (SELECT unnest([{", ".join(f"{g}::DOUBLE" for g in _GRID)}]) AS t) GROUP BY 1, 2)
SELECT bucket, t AS temperature, round(loss, 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY round(loss, 9), t) AS r FROM t WHERE n >= 30) WHERE r = 1"""


def ece_by_bucket(spark, d):
    return calibrate.ece(_confidence(spark, d), "bucket").select("bucket", F.round("ece", 6).alias("ece"), "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


_ECE = f"""WITH {_P}, b AS (SELECT bucket, greatest(1, len(list_filter(range(0, 16), lambda i: i / 15.0::DOUBLE < conf))) AS bin, count(*) AS c, sum(conf) AS s, sum(correct) AS k FROM c GROUP BY 1, 2)
SELECT bucket, round(sum(abs(s - k)) / sum(c), 6) AS ece, sum(c)::BIGINT AS n, round(sum(s) / sum(c), 6) AS mean_confidence, round((sum(k) / sum(c))::DOUBLE, 6) AS accuracy FROM b GROUP BY 1"""


def abstention_cut(spark, d):
    return calibrate.abstention_cuts(_confidence(spark, d), "bucket", 0.6).select("bucket", F.round("cut", 6).alias("cut"))


_CUT = f"""WITH {_P}, s AS (SELECT bucket, conf, count(*) OVER w AS n, sum(1 - correct) OVER w AS e FROM c WINDOW w AS (PARTITION BY bucket ORDER BY conf DESC RANGE UNBOUNDED PRECEDING)),
u AS (SELECT bucket, conf, n, (e / n::DOUBLE + 1.28 * 1.28 / (2 * n) + 1.28 * sqrt(e / n::DOUBLE * (1 - e / n::DOUBLE) / n + 1.28 * 1.28 / (4.0::DOUBLE * n * n))) / (1 + 1.28 * 1.28 / n) AS err FROM s)
SELECT bucket, round(coalesce(min(CASE WHEN err <= 0.6 THEN conf END), 1.0::DOUBLE), 6) AS cut FROM u GROUP BY bucket HAVING max(n) >= 20"""


def coverage_at_cut(spark, d):
    out = calibrate.coverage(_confidence(spark, d), F.when(F.col("k") == 2, 0.6).otherwise(0.3))
    return out.select(F.round("coverage", 6).alias("coverage"), F.round("selective_accuracy", 6).alias("selective_accuracy"), "n")


def _labelled(spark, d):
    return _confidence(spark, d).withColumns({"task": F.concat(F.lit("t"), F.pmod("vec_id", F.lit(3))), "lang": F.element_at(F.array(*map(F.lit, ("en", "hi", "mr", "ta", "bn"))), (F.pmod("vec_id", F.lit(5)) + 1).cast("int")), "negative": F.pmod("vec_id", F.lit(10)) < 3})


_M = f"""{_P}, m AS (SELECT *, 't' || (vec_id % 3) AS task, ['en', 'hi', 'mr', 'ta', 'bn'][vec_id % 5 + 1] AS lang, vec_id % 10 < 3 AS negative FROM c)"""


def eval_by_group(spark, d):
    out = evals.metrics_by(_labelled(spark, d), "task", "lang", "bucket")
    return out.select("dimension", "value", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "negative_error_rate")])


_EVAL = f"""WITH {_M} SELECT CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS dimension, coalesce(task, lang, bucket) AS value, count(*) AS n,
  round(avg(correct), 6) AS accuracy, round(avg(pow(conf - correct, 2)), 6) AS brier, round(count(CASE WHEN negative AND correct = 0 THEN 1 END) / nullif(count(CASE WHEN negative THEN 1 END), 0)::DOUBLE, 6) AS negative_error_rate
FROM m GROUP BY GROUPING SETS ((), (task), (lang), (bucket))"""


def release_gates(spark, d):
    groups = evals.metrics_by(_labelled(spark, d), "lang")
    overall = groups.where("dimension = 'all'")
    metrics = overall.select(F.explode(F.array(F.struct(F.lit("accuracy_overall").alias("name"), F.col("accuracy").alias("value")), F.struct(F.lit("false_positive_rate_negatives_max").alias("name"), F.col("negative_error_rate").alias("value")))).alias("m")).select("m.*")
    worst = groups.where("dimension = 'lang'").agg(F.min("accuracy").alias("value")).select(F.lit("accuracy_per_language_min").alias("name"), "value")
    return evals.gates(metrics.unionByName(worst), {"accuracy_overall": 0.05}).select("name", F.round("value", 6).alias("value"), "threshold", "ok")


_GATES = dict(evals.GATES) | {"accuracy_overall": 0.05}
_GATE_SQL = f"""WITH {_M}, v AS (
  SELECT 'accuracy_overall' AS name, avg(correct) AS value FROM m
  UNION ALL SELECT 'false_positive_rate_negatives_max', count(CASE WHEN negative AND correct = 0 THEN 1 END) / count(CASE WHEN negative THEN 1 END)::DOUBLE FROM m
  UNION ALL SELECT 'accuracy_per_language_min', min(a) FROM (SELECT lang, avg(correct) AS a FROM m GROUP BY lang))
SELECT g.name, round(value, 6) AS value, threshold::DOUBLE AS threshold, coalesce(CASE WHEN g.name LIKE '%\\_max' ESCAPE '\\' THEN value <= threshold ELSE value >= threshold END, false) AS ok FROM (SELECT * FROM {dim.sql_values(list(_GATES.items()), "g(name, threshold)")}) g LEFT JOIN v USING (name)"""


def agreement_metrics(spark, d):
    rows = _scored(spark, d).select(F.col("logits").alias("a"), F.transform("logits", lambda x: F.round(x * 4) / 4).alias("b"))
    out = evals.agreement(rows)
    return out.select("n", "n_decisive", *[F.round(c, 6).alias(c) for c in ("top1", "decisive_top1", "mean_abs_delta", "mean_kl")])


_AGREE = f"""WITH {_L}, ab AS (SELECT z AS a, list_transform(z, lambda v: round(v * 4) / 4) AS b FROM l),
s AS (SELECT a, b, list_transform(list_transform(a, lambda v: exp(v - list_max(a))), lambda v: v / list_sum(list_transform(a, lambda u: exp(u - list_max(a))))) AS p, list_transform(list_transform(b, lambda v: exp(v - list_max(b))), lambda v: v / list_sum(list_transform(b, lambda u: exp(u - list_max(b))))) AS q FROM ab),
r AS (SELECT list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same, list_avg(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS delta,
  list_sum(list_transform(range(1, len(a) + 1), lambda i: p[i] * ln(greatest(p[i], 1e-9) / greatest(q[i], 1e-9)))) AS kl, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] >= 0.02 AS decisive FROM s)
SELECT count(*) AS n, count(CASE WHEN decisive THEN 1 END) AS n_decisive, round(avg(same::INTEGER), 6) AS top1, round(count(CASE WHEN decisive AND same THEN 1 END) / count(CASE WHEN decisive THEN 1 END)::DOUBLE, 6) AS decisive_top1, round(avg(delta), 6) AS mean_abs_delta, round(avg(kl), 6) AS mean_kl FROM r"""


def proper_reward(spark, d):
    rows = _confidence(spark, d).withColumn("target", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(i == F.col("gold"), 1.0).otherwise(0.0)))
    return rows.select("vec_id", F.round(decode.reward(F.col("p"), F.col("target"), F.col("k") == 4), 6).alias("reward"))


_REWARD = f"""WITH {_P} SELECT vec_id, round(greatest(ln(greatest(p[gold + 1], 1e-12)), -9.21) + 0.5 * p[gold + 1] / sqrt(list_sum(list_transform(p, lambda v: v * v)))
  - CASE WHEN k = 4 THEN list_sum(list_transform(range(1, k + 1), lambda i: pow(list_sum(p[1:i]) - CASE WHEN i > gold THEN 1 ELSE 0 END, 2))) / (k - 1) ELSE 0 END, 6) AS reward FROM p"""


def template_split(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", dataset.split_bucket(F.col("p_name")).alias("bucket"), dataset.split_of(F.col("p_name")).alias("split"))


_SPLIT = "('0x' || substr(sha256({k}), 1, 8))::BIGINT % 100"


def _rows(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", "lang", "source", F.concat("source", F.lit("/"), F.pmod("doc_id", F.lit(97))).alias("template")).withColumn("split", dataset.split_of(F.col("template")))


_R = f"r AS (SELECT doc_id, lang, source, template, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_SPLIT.format(k='template')} AS b FROM (SELECT doc_id, lang, source, source || '/' || (doc_id % 97) AS template FROM documents)))"


def dataset_stats(spark, d):
    return dataset.stats(_rows(spark, d), "split", "lang", "source")


def split_overlap(spark, d):
    rows = _rows(spark, d).select(F.element_at(F.split("template", "/"), 2).alias("template"), "split")
    return dataset.split_overlap(rows)


def rare_class_weights(spark, d):
    out = dataset.rare_class_weights(spark.read.parquet(f"{d}/documents.parquet"), "lang", "source")
    return out.select("lang", "source", "n", F.round("weight", 6).alias("weight"))


def round_robin_sample(spark, d):
    return dataset.round_robin(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "source", "doc_id", 50)


def prefix_dedupe(spark, d):
    return dataset.prefix_dedupe(spark.read.parquet(f"{d}/documents.parquet"), "text", "doc_id", 24)


def variant_expansion(spark, d):
    langs = F.array(*map(F.lit, ("en", "hi", "mr", "ta", "bn")))
    t = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("template"), F.concat("p_name", F.lit(" of ₹"), "p_brand").alias("text"), F.element_at(langs, (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")).alias("lang"))
    return dataset.expand_variants(t, 3)


_DRAW = "(('0x' || substr(sha256(concat_ws('|', template, variant, '{0}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_FILLER = "CASE lang " + " ".join(f"WHEN '{x}' THEN {list(ws)}[floor({_DRAW.format('filler')} * {len(ws)})::INTEGER + 1]" for x, ws in dataset.FILLERS.items()) + f" ELSE '{dataset.OTHER_FILLER}' END"
_LIKE = "CASE " + " ".join(f"WHEN contains(m, '{x}') THEN regexp_replace(z, '^([^{x}]*){x}', '\\1{y}')" for x, y in dataset.LOOKALIKES.items()) + " ELSE z END"
_VARIANTS = f"""WITH t AS (SELECT p_name AS template, p_name || ' of ₹' || p_brand AS text, ['en', 'hi', 'mr', 'ta', 'bn'][p_partkey % 5 + 1] AS lang, unnest([0, 1, 2]) AS variant FROM part),
a AS (SELECT *, CASE WHEN {_DRAW.format("prefix")} < 0.35 THEN 'FYI: ' || text ELSE text END AS p FROM t), b AS (SELECT *, CASE WHEN {_DRAW.format("suffix")} < 0.3 THEN p || ' Reply soon.' ELSE p END AS s FROM a),
c AS (SELECT *, CASE WHEN {_DRAW.format("mix")} < 0.25 THEN s || ' ' || {_FILLER} ELSE s END AS m FROM b), d AS (SELECT *, floor({_DRAW.format("place")} * length(m))::INTEGER AS k FROM c),
e AS (SELECT *, left(m, k) || chr(8203) || substr(m, k + 1) AS z FROM d), f AS (SELECT *, CASE WHEN {_DRAW.format("hide")} < 0.22 THEN {_LIKE} ELSE m END AS h FROM e),
g AS (SELECT *, CASE WHEN {_DRAW.format("twice")} < 0.5 THEN regexp_replace(h, '^([^ ]*) ', '\\1  ') ELSE h END AS n1 FROM f), i AS (SELECT *, CASE WHEN {_DRAW.format("shout")} < 0.3 THEN n1 || ' !!!' ELSE n1 END AS n2 FROM g),
j AS (SELECT *, CASE WHEN {_DRAW.format("rupees")} < 0.2 THEN replace(n2, '₹', 'Rs ') ELSE n2 END AS n3, {_SPLIT.format(k="template")} AS q FROM i)
SELECT template, lang, variant, CASE WHEN {_DRAW.format("noise")} < 0.25 THEN n3 ELSE h END AS text, CASE WHEN q < 70 THEN 'train' WHEN q < 85 THEN 'val' ELSE 'test' END AS split FROM j"""


def transcript_hard_split(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.posexplode(windows.hard_split(F.col("text"), 900)).alias("i", "x")).select("doc_id", "i", F.col("x.start").alias("start"), F.length("x.piece").alias("size"))


_HARD = """WITH n AS (SELECT doc_id, length(text) AS len, greatest(1, ceil(length(text) / 900.0::DOUBLE))::INTEGER AS n FROM documents), s AS (SELECT doc_id, len, greatest(1, ceil(len / n::DOUBLE))::INTEGER AS step FROM n)
SELECT doc_id, ((start / step)::INTEGER) AS i, start::INTEGER AS start, least(step, len - start)::INTEGER AS size FROM (SELECT doc_id, len, step, unnest(range(0, len, step)) AS start FROM s)"""


def _transcripts(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    lines = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return lines.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def transcript_windows(spark, d):
    return windows.windows(_transcripts(spark, d), "conv_id", "text").select("conv_id", "index", "start", "stop", "units", "strategy", "left_out")


_BREAK = "chr(1)"  # stands where a unit begins
_MARK = lambda pattern, new: f"string_split(regexp_replace(t, '{pattern.replace(chr(39), chr(39) * 2)}', {new}, 'g'), {_BREAK})"
_TURNS = _MARK("(?i)(^|\\n)(" + windows.TURN.pattern.removeprefix("(^|\\n)") + ")", f"'\\1' || {_BREAK} || '\\2'")
_ENDED = lambda pattern: f"list_filter({_MARK(f'({pattern})', f'{chr(39)}{chr(92)}1{chr(39)} || {_BREAK}')}, lambda x: x <> '')"
#: Windows by a recursion: the next one begins where at most 120 characters of whole units overlap, one unit on at least, and holds
#: as many whole units as fit into 900 characters, one at least.
_WINDOWS = f"""RECURSIVE c AS (SELECT conv_id, replace(replace(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, t, length(t) AS n, {_TURNS} AS turns, {_ENDED(windows.PARAGRAPH.pattern)} AS paragraphs, {_ENDED(windows.SENTENCE.pattern)} AS sentences, ceil(length(t) / ceil(length(t) / 900.0::DOUBLE))::BIGINT AS step FROM c),
s AS (SELECT *, CASE WHEN n <= 900 THEN 'single' WHEN len(turns) > 2 THEN 'turns' WHEN len(paragraphs) > 1 THEN 'paragraphs' WHEN len(sentences) > 1 THEN 'sentences' ELSE 'hard' END AS strategy FROM k WHERE n > 0),
p AS (SELECT conv_id, strategy, n, t, CASE strategy WHEN 'turns' THEN length(turns[1]) ELSE 0 END AS shift,
  CASE strategy WHEN 'turns' THEN turns[2:] WHEN 'paragraphs' THEN paragraphs WHEN 'sentences' THEN sentences ELSE list_transform(range(0, n, step), lambda i: substr(t, i + 1, step)) END AS pieces FROM s),
u AS (SELECT conv_id, strategy, shift, list_transform(range(0, len(pieces) + 1), lambda i: coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)::BIGINT) AS b FROM p WHERE strategy <> 'single'),
w AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS f, greatest(1, len(list_filter(b, lambda v: v <= 900)) - 1)::BIGINT AS e FROM u
  UNION ALL SELECT conv_id, i + 1, g, greatest(g + 1, len(list_filter(b, lambda v: v <= b[g + 1] + 900)) - 1)::BIGINT
  FROM (SELECT conv_id, b, i, greatest(f + 1, len(list_filter(b, lambda v: v < b[e + 1] - 120)))::BIGINT AS g FROM w JOIN u USING (conv_id) WHERE e < len(b) - 1)),
a AS (SELECT conv_id, i, shift + b[f + 1] AS start, shift + b[e + 1] AS stop, e - f AS units, strategy, count(*) OVER (PARTITION BY conv_id) AS total FROM w JOIN u USING (conv_id)),
windows AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS index, start::BIGINT AS start, stop::BIGINT AS stop, units::INTEGER AS units, strategy, greatest(0, total - 8)::INTEGER AS left_out FROM a WHERE i < 4 OR i >= total - 4
  UNION ALL SELECT conv_id, 0, 0, n, 1, strategy, 0 FROM p WHERE strategy = 'single' AND trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12)) <> '')"""


def lens_aggregate(spark, d):
    rows = windows.windows(_transcripts(spark, d), "conv_id", "text").select("conv_id", "index", (F.pmod(F.length("text") * 7 + F.col("index"), F.lit(100)) / 100).alias("p"), (F.pmod(F.length("text"), F.lit(4)) == 0).alias("abstained"))
    return windows.lens(rows, "conv_id", "p", "p").withColumn("mean_promotion", F.round("mean_promotion", 9))


_LENS = f"""WITH {_WINDOWS}, x AS (SELECT conv_id, index, (((stop - start) * 7 + index) % 100) / 100.0::DOUBLE AS p, (stop - start) % 4 = 0 AS abstained FROM windows)
SELECT conv_id, round(avg(p) FILTER (WHERE NOT abstained), 9) AS mean_promotion, count(*) AS windows, count(CASE WHEN abstained THEN 1 END) AS abstained,
  first(index ORDER BY p DESC, index) FILTER (WHERE NOT abstained) AS worst, min(index) FILTER (WHERE NOT abstained) AS headline FROM x GROUP BY conv_id"""


def offset_to_window(spark, d):
    w = windows.windows(_transcripts(spark, d), "conv_id", "text")
    offsets = w.groupBy("conv_id").agg(F.max("stop").alias("len")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1, F.lit(250).cast("bigint"))).alias("pos"))
    return windows.window_of(offsets, w, "conv_id").select("conv_id", "pos", "index")


_OFFSETS = f"""WITH {_WINDOWS}, o AS (SELECT conv_id, unnest(range(0, max(stop), 250)) AS pos FROM windows GROUP BY conv_id)
SELECT conv_id, pos, index FROM o JOIN windows USING (conv_id) WHERE pos >= start AND pos < stop"""


def word_frequency_topk(spark, d):
    return dataset.word_counts(spark.read.parquet(f"{d}/documents.parquet"), "text").orderBy(F.desc("n"), "word").limit(100)


def _merges(spark, d):
    """Merges of the distinct part names' prefixes: each prefix is made of the one before and a letter."""
    names = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct()
    cut = names.select("p_name", F.explode(F.sequence(F.lit(2), F.length("p_name"))).alias("i"))
    return cut.select(F.expr("left(p_name, i - 1)").alias("left"), F.expr("substr(p_name, i, 1)").alias("right"), F.expr("left(p_name, i)").alias("result")).distinct()


def merge_closure(spark, d):
    return dataset.merge_closure(_merges(spark, d), spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("token")))


_CLOSURE = """WITH RECURSIVE m AS (SELECT DISTINCT left(p_name, i - 1) AS l, substr(p_name, i, 1) AS r, left(p_name, i) AS t FROM (SELECT p_name, unnest(range(2, length(p_name) + 1)) AS i FROM part)),
c AS (SELECT DISTINCT p_name AS token FROM part UNION SELECT x FROM (SELECT unnest([m.l, m.r]) AS x FROM c JOIN m ON m.t = c.token)) SELECT token FROM c"""


def vocab_prune(spark, d):
    """Names of parts as tokens; those are kept that more than one part has."""
    vocab = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_name").alias("token")).agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("n"))
    return dataset.prune_vocabulary(vocab.select("token", "id"), vocab.where("n > 1").select("token"))


def _tokenizer_file() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def vocab_prune_corpus(spark, d):
    return vocabulary.prune_by_corpus(spark.read.parquet(f"{d}/documents.parquet"), "text", _tokenizer_file())[0]


def vocab_drift(spark, d):
    docs, tokenizer = spark.read.parquet(f"{d}/documents.parquet"), _tokenizer_file()
    _, pruned, new = vocabulary.prune_by_corpus(docs, "text", tokenizer)
    return vocabulary.drift(docs, "text", tokenizer, pruned, new)


def sequence_layout(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", F.explode(F.array(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), F.ascii))).alias("state"))
    options = F.transform(F.sequence(F.lit(1), (F.pmod("doc_id", F.lit(5)) + 2).cast("int")), lambda i: F.slice("state", i * 3, 60))
    rows = rows.select("doc_id", "state", F.slice("state", 1, 40).alias("head"), options.alias("options"))
    out = dataset.sequence_layout(rows, "head", "options", "state", 512, 128, 1, 2, 3)
    return out.select("doc_id", F.size("ids").alias("size"), F.size("markers").alias("markers"), F.aggregate("markers", F.lit(0), lambda a, b: a + b).alias("marker_sum"))


#: Only sizes count: an option of i * 3 on has 60 characters at most, of which 48 are taken behind its mask.
_LAYOUT = """WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 5 + 2 AS k FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, list_transform(range(1, k + 1), lambda i: 1 + least(48, greatest(0, n - i * 3 + 1))) AS cut FROM d),
f AS (SELECT doc_id, n, CASE WHEN 128 - list_sum(cut) < 16 THEN list_transform(cut, lambda c: least(c, greatest(4, 112 // k))) ELSE cut END AS final FROM o),
h AS (SELECT *, least(n, 40, greatest(8, 128 - list_sum(final))) + 2 AS front FROM f),
b AS (SELECT *, front + list_sum(final) + 1 AS body, list_filter(list_transform(range(0, len(final)), lambda i: front + coalesce(list_sum(final[1:i]), 0)), lambda m: m < 512) AS marks FROM h)
SELECT doc_id, least(512, body + least(n, greatest(0, 511 - body)) + 1)::INTEGER AS size, len(marks)::INTEGER AS markers, coalesce(list_sum(marks), 0)::INTEGER AS marker_sum FROM b"""


QUERIES = {
    "softmax_decode": (softmax_decode, f"WITH {_P} SELECT vec_id, (i - 1)::INTEGER AS option, round(p[i], 9) AS p FROM p, range(1, 13) t(i) WHERE i <= k"),
    "entropy_confidence": (entropy_confidence, f"WITH {_P} SELECT vec_id, round(1 + list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12)))) / ln(k), 8) AS entropy, round(conf, 8) AS conf FROM c"),
    "unpermute": (unpermute, f"WITH {_P} SELECT vec_id, (i % k)::INTEGER AS option, round(p[i], 9) AS p FROM p, range(1, 13) t(i) WHERE i <= k"),
    "abstain_flags": (abstain_flags, f"WITH {_P}, f AS (SELECT bucket, CASE bucket WHEN 'choice:2' THEN 0.4 WHEN 'choice:3-5' THEN 0.3 WHEN 'choice:6-10' THEN 0.15 ELSE 0.2 END::DOUBLE AS cut, 1 + list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12)))) / ln(k) AS h FROM c) SELECT bucket, cut, h < cut AS abstained, count(*) AS n FROM f GROUP BY 1, 2, 3"),
    "bucket_lookup": (bucket_lookup, f"WITH {_L} SELECT k::INTEGER AS k, (CASE k WHEN 2 THEN 2.5 WHEN 12 THEN 1.0 ELSE 1.5 END)::DOUBLE AS t, count(*) AS n FROM l GROUP BY 1, 2"),
    "temperature_grid_fit": (temperature_grid_fit, _FIT),
    "ece_by_bucket": (ece_by_bucket, _ECE),
    "abstention_cut": (abstention_cut, _CUT),
    "coverage_at_cut": (coverage_at_cut, f"WITH {_P}, f AS (SELECT correct, conf >= CASE WHEN k = 2 THEN 0.6 ELSE 0.3 END AS kept FROM c) SELECT round(avg(kept::INTEGER), 6) AS coverage, round(count(CASE WHEN kept AND correct = 1 THEN 1 END) / count(CASE WHEN kept THEN 1 END)::DOUBLE, 6) AS selective_accuracy, count(*) AS n FROM f"),
    "eval_by_group": (eval_by_group, _EVAL),
    "release_gates": (release_gates, _GATE_SQL),
    "agreement_metrics": (agreement_metrics, _AGREE),
    "proper_reward": (proper_reward, _REWARD),
    "template_split": (template_split, f"SELECT p_partkey, b AS bucket, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT p_partkey, {_SPLIT.format(k='p_name')} AS b FROM part)"),
    "dataset_stats": (dataset_stats, f"WITH {_R} SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(split, lang, source) AS value, count(*) AS n, count(DISTINCT template) AS templates FROM r GROUP BY GROUPING SETS ((split), (lang), (source))"),
    "split_overlap": (split_overlap, f"WITH {_R}, s AS (SELECT DISTINCT string_split(template, '/')[2] AS template, split FROM r), p AS (SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y ON x.template = y.template AND x.split < y.split GROUP BY 1, 2) SELECT a, b, coalesce(shared, 0)::BIGINT AS shared FROM (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) v(a, b) LEFT JOIN p USING (a, b)"),
    "rare_class_weights": (rare_class_weights, "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), w AS (SELECT *, pow((SELECT sum(n) FROM c) / n, 0.35) AS w FROM c) SELECT lang, source, n, round(w / avg(w) OVER (), 6) AS weight FROM w"),
    "round_robin_sample": (round_robin_sample, "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50"),
    "prefix_dedupe": (prefix_dedupe, "SELECT left(lower(text), 24) AS prefix, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"),
    "variant_expansion": (variant_expansion, _VARIANTS),
    "transcript_hard_split": (transcript_hard_split, _HARD),
    "transcript_windows": (transcript_windows, f"WITH {_WINDOWS} SELECT * FROM windows"),
    "lens_aggregate": (lens_aggregate, _LENS),
    "offset_to_window": (offset_to_window, _OFFSETS),
    "word_frequency_topk": (word_frequency_topk, r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100"),
    "merge_closure": (merge_closure, _CLOSURE),
    "vocab_prune": (vocab_prune, "SELECT token, id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT p_name AS token, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1) WHERE n > 1"),
    "vocab_prune_corpus": (vocab_prune_corpus, None),
    "vocab_drift": (vocab_drift, None),
    "sequence_layout": (sequence_layout, _LAYOUT),
}
