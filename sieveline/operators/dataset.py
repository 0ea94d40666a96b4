"""Building of training sets: splits, leakage, weights, sampling, variants, sequences, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_bucket(key: Column) -> Column:
    """0..99 from the first eight hex digits of the key's sha256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def split_of(key: Column) -> Column:
    b = split_bucket(key)
    return F.when(b < 70, "train").when(b < 85, "val").otherwise("test")


def stats(rows: DataFrame, *dims: str, template: str = "template") -> DataFrame:
    """dimension, value, n, templates by each dimension, in one pass of grouping sets."""
    keys = [F.col(d) for d in dims]
    sets = rows.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id(*keys).alias("_g"), F.count(F.lit(1)).alias("n"), F.countDistinct(template).alias("templates"))
    full = (1 << len(dims)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        on = F.col("_g") == full - (1 << (len(dims) - 1 - i))
        name, value = F.when(on, d).otherwise(name), F.when(on, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n", "templates")


def split_overlap(rows: DataFrame, template: str = "template", split: str = "split") -> DataFrame:
    """a, b, shared: templates in two splits, for all three pairs (0 where there are none). One pass: splits per template as flags."""
    flags = rows.groupBy(template).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = (("test", "train"), ("test", "val"), ("train", "val"))
    wide = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])).alias("x")).select("x.*")


def rare_class_weights(rows: DataFrame, *keys: str, power: float = 0.35) -> DataFrame:
    """keys, n, weight = (rows / n) ** power, scaled to mean 1 over the classes."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    raw = counts.join(F.broadcast(total)).withColumn("_raw", F.pow(F.col("_total") / F.col("n"), F.lit(power)))
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    return raw.join(F.broadcast(mean)).select(*keys, "n", (F.col("_raw") / F.col("_mean")).alias("weight"))


def item_weight(weight: Column, negative: Column, boost: float = 1.6) -> Column:
    return F.coalesce(weight, F.lit(1.0)) * F.when(negative, boost).otherwise(1.0)


def round_robin(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first `limit` rows dealt one from each group in turn (a sample of fixed size)."""
    w = Window.partitionBy(group).orderBy(order)
    ranked = rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= limit)
    return ranked.orderBy("_turn", group).limit(limit).drop("_turn")


def prefix_dedupe(rows: DataFrame, text: str, order: str, length: int) -> DataFrame:
    """One row, the first by order, of those whose lower-cased text starts alike."""
    return rows.groupBy(F.left(F.lower(text), F.lit(length)).alias("prefix")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"))


def uniform(*parts: Column) -> Column:
    """A number in 0..1 fixed by its parts, the same in any engine with sha256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


# Look-alikes in the order in which they are tried, and fillers of forwarded texts by language.
LOOKALIKES = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "y": "у"}
FILLERS = {"hi": ("bhai", "jaldi", "turant", "paisa", "confirm karo"), "mr": ("bhau", "lagech", "paisa", "confirm kara"), "ta": ("thambi", "udane", "panam"), "en": ("bro", "urgent", "money")}
OTHER_FILLER = "ok"


def obfuscate(text: Column, u: Column) -> Column:
    """text with a hidden character at the place u (0..1) and the first look-alike that it has a letter for, once."""
    at = F.floor(u * F.length(text)).cast("int")
    hidden = F.concat(F.substring(text, F.lit(1), at), F.lit("\u200b"), F.substring(text, at + 1, F.length(text)))
    out = hidden
    for letter, like in reversed(LOOKALIKES.items()):
        out = F.when(F.contains(text, F.lit(letter)), F.regexp_replace(hidden, f"^([^{letter}]*){letter}", f"$1{like}")).otherwise(out)
    return F.when(F.length(text) > 0, out).otherwise(text)


def with_filler(text: Column, lang: Column, u: Column) -> Column:
    """text with one of its language's fillers behind it."""
    filler = F.lit(OTHER_FILLER)
    for name, words in FILLERS.items():
        filler = F.when(lang == name, F.element_at(F.array(*map(F.lit, words)), (F.floor(u * len(words)) + 1).cast("int"))).otherwise(filler)
    return F.concat(text, F.lit(" "), filler)


def noisy(text: Column, twice: Column, shout: Column, rupees: Column) -> Column:
    """text with its first space doubled, three exclamation marks behind it and the rupee sign spelled out, each where its number (0..1) is low."""
    text = F.when(twice < 0.5, F.regexp_replace(text, "^([^ ]*) ", "$1  ")).otherwise(text)
    text = F.when(shout < 0.3, F.concat(text, F.lit(" !!!"))).otherwise(text)
    return F.when(rupees < 0.2, F.replace(text, F.lit("₹"), F.lit("Rs "))).otherwise(text)


def expand_variants(templates: DataFrame, variants: int) -> DataFrame:
    """Every template (template, text, lang) in `variants` forms: a prefix, a suffix, a filler, hidden characters and noise, each by its own fixed chance."""
    rows = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    u = lambda name: uniform(F.col("template"), F.col("variant"), F.lit(name))
    text = F.when(u("prefix") < 0.35, F.concat(F.lit("FYI: "), F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("_t", F.when(u("suffix") < 0.3, F.concat(text, F.lit(" Reply soon."))).otherwise(text))
    rows = _once(rows, "_m", F.when(u("mix") < 0.25, with_filler(F.col("_t"), F.col("lang"), u("filler"))).otherwise(F.col("_t")))
    rows = _once(rows, "_h", F.when(u("hide") < 0.22, obfuscate(F.col("_m"), u("place"))).otherwise(F.col("_m")))
    text = F.when(u("noise") < 0.25, noisy(F.col("_h"), u("twice"), u("shout"), u("rupees"))).otherwise(F.col("_h"))
    return rows.select("template", "lang", "variant", text.alias("text"), split_of(F.col("template")).alias("split"))


def eligible(rows: DataFrame, tasks: tuple[str, ...] | None = None, splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """rows of the given splits and tasks (None: all)."""
    rows = rows.where(F.col("split").isin(*splits))
    return rows if tasks is None else rows.where(F.col("task").isin(*tasks))


def unclamped(items: DataFrame, markers: str, keys: str) -> DataFrame:
    """Items whose options all kept their marker."""
    return items.where(F.size(markers) == F.size(keys))


def first_best(target: Column) -> Column:
    """Position from 0 of the first largest target: an item's label."""
    return F.array_position(target, F.array_max(target)) - 1


def collate(items: DataFrame, batch: str, ids: str, markers: str, pad: int) -> DataFrame:
    """items with ids and markers filled up to their batch's longest, and masks (1 where there is something)."""
    sizes = items.groupBy(batch).agg(F.max(F.size(ids)).alias("_ids"), F.max(F.size(markers)).alias("_markers"))
    fill = lambda c, to, v: F.concat(c, F.array_repeat(F.lit(v), F.col(to) - F.size(c)))
    mask = lambda c, to: F.concat(F.transform(c, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col(to) - F.size(c)))
    out = {ids: fill(ids, "_ids", pad), markers: fill(markers, "_markers", 0), f"{ids}_mask": mask(ids, "_ids"), f"{markers}_mask": mask(markers, "_markers")}
    return items.join(sizes, batch).withColumns(out).drop("_ids", "_markers")


def numbered(rows: DataFrame, order: str, block: int = 4096) -> DataFrame:
    """rows with `number` from 0 by a whole-number order: counted per block of it, and within each block by a window."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / block))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).join(starts, "_b").withColumn("number", F.col("_s") + F.col("_r")).drop("_b", "_r", "_s")


def rank_shards(rows: DataFrame, order: str, world: int) -> DataFrame:
    """rows with rank and step: dealt to `world` ranks in turn; what does not make a full turn is left out."""
    n = rows.agg(F.count(F.lit(1)).alias("_all"))
    out = numbered(rows, order).join(F.broadcast(n)).where(F.col("number") < F.col("_all") - F.pmod("_all", F.lit(world)))
    return out.withColumns({"rank": F.pmod("number", F.lit(world)), "step": F.floor(F.col("number") / world)}).drop("number", "_all")


def hold_out(rows: DataFrame, key: str, seed: int, share: float = 0.1) -> DataFrame:
    """rows with held_out: about the share of them, fixed by key and seed."""
    return rows.withColumn("held_out", uniform(F.col(key), F.lit(seed)) < share)


def soft_target(label: Column, k: int, sure: float = 0.98) -> Column:
    """Probabilities over k options with `sure` on the label and the rest shared."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, sure).otherwise((1 - sure) / (k - 1)))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all white-space words of all texts."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def merge_closure(merges: DataFrame, kept: DataFrame) -> DataFrame:
    """token: the kept tokens and, to the fixed point, the parts of every merge that makes a token in the set.

    merges (left, right, result), kept (token). Each step joins only the tokens that the last one found new, each once however
    many merges lead to it, and is a reliable checkpoint where the session has a folder for those. Ends when a step finds none.
    """
    has_folder = merges.sparkSession.sparkContext.getCheckpointDir() is not None
    keep = lambda df: df.checkpoint() if has_folder else df.persist()
    new = known = keep(kept.select("token").distinct())
    while not new.isEmpty():
        parts = new.join(merges, new["token"] == merges["result"]).select(F.explode(F.array("left", "right")).alias("token")).distinct()
        new = keep(parts.join(known, "token", "left_anti"))
        known = known.unionAll(new)
    return known


def prune_vocabulary(vocab: DataFrame, kept: DataFrame) -> DataFrame:
    """token, id, new_id: kept tokens numbered densely by their old id.

    Numbers come from counts per block of ids and a window within each block, so that no task gets the whole vocabulary.
    """
    rows = vocab.join(kept.select("token").distinct(), "token").withColumn("_b", F.floor(F.col("id") / 4096))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    w = Window.partitionBy("_b").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(starts), "_b").select("token", "id", (F.col("_s") + F.col("_r")).alias("new_id"))


def remap(ids: Column, mapping: Column) -> Column:
    """ids through a map; an id without an entry raises."""
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(mapping, i), F.raise_error(F.concat(F.lit("id was pruned: "), i.cast("string"))).cast("bigint")))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that the optimiser computes once and does not copy into its uses."""
    return rows.withColumn(name, F.explode(F.array(value)))


def sequence_layout(rows: DataFrame, head: str, options: str, state: str, max_len: int, head_max: int, cls: int, sep: int, mask: int, option_max: int = 48) -> DataFrame:
    """rows with ids and markers: [cls] head [sep] ([mask] option)* [sep] state [sep] within max_len, and the places of the masks.

    Options are cut to option_max ids; if fewer than 16 ids are left for the head, all options are cut evenly (4 at least), and
    the head keeps 8 at least. The state gets what room remains.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, o: s + F.size(o))
    rows = _once(rows, "_cut", F.transform(options, lambda o: F.concat(F.array(F.lit(mask)), F.slice(o, 1, option_max))))
    per = F.greatest(F.lit(4), F.floor(F.lit(head_max - 16) / F.greatest(F.lit(1), F.size("_cut"))).cast("int"))
    rows = _once(rows.withColumn("_per", per).withColumn("_all", total("_cut")), "_final", F.when(F.lit(head_max) - F.col("_all") < 16, F.transform("_cut", lambda o: F.slice(o, F.lit(1), F.col("_per")))).otherwise(F.col("_cut")))
    head_ids = F.slice(head, F.lit(1), F.greatest(F.lit(8), F.lit(head_max) - total("_final")))
    rows = _once(rows, "_front", F.concat(F.array(F.lit(cls)), head_ids, F.array(F.lit(sep))))
    rows = _once(rows, "_body", F.concat("_front", F.flatten("_final"), F.array(F.lit(sep))))
    room = F.greatest(F.lit(0), F.lit(max_len - 1) - F.size("_body"))
    ids = F.slice(F.concat("_body", F.slice(state, F.lit(1), room), F.array(F.lit(sep))), 1, max_len)
    starts = F.aggregate("_final", F.struct(F.size("_front").alias("at"), F.array().cast("array<int>").alias("out")), lambda s, o: F.struct((s["at"] + F.size(o)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    return rows.withColumns({"ids": ids, "markers": F.filter(starts, lambda m: m < max_len)}).drop("_cut", "_per", "_all", "_final", "_front", "_body")
