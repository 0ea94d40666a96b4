"""Language identification by word-first backoff: word log frequencies, then character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Growing, id_crc, mix64, steps, word_hashes

#: Lengths of the character n-grams, in the order in which an unseen word falls back to them.
GRAMS = (5, 4, 3, 2, 1)
#: Documents the model is fitted on at most (expected number of a hash sample, shared out evenly among the languages).
FIT_DOCS = 20_000
SMOOTH = 0.5
#: Words that must be known for a text's language to count as known, as a share of its words, and n-grams of an unseen word that
#: must be known for that word to count, as a share of its n-grams of this length.
MIN_KNOWN = 0.5
KNOWN_GRAM = 3

_WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_COUNTS = "lang string, word string, n bigint"
_HASHES = "size int, hash bigint, lang string, n bigint"
_SPACE = 32


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_windows(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, each with a space before and behind, and the word that each is of; no lone space."""
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    count = len(chars) - n + 1
    if not words or count < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    spaces = np.concatenate([[0], np.cumsum(chars == _SPACE)])
    inner = spaces[n - 1 : n - 1 + count] - spaces[1 : 1 + count] if n > 1 else spaces[1:] - spaces[:-1]
    at = np.flatnonzero(inner == 0)
    h = np.full(len(at), n * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + chars[at + k].astype(np.uint64))
    return h, spaces[at + 1] - 1


@dataclass
class LogTable:
    """Rows of log frequencies by language, for sorted 64-bit hashes."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == hashes, at, -1) if len(self.hashes) else np.full(len(hashes), -1)


def _log_table(hashes: np.ndarray, counts: np.ndarray) -> LogTable:
    total = counts.sum(axis=0, dtype=float)
    order = np.argsort(hashes)
    return LogTable(hashes[order], np.log((counts[order] + SMOOTH) / (total + SMOOTH * (len(counts) + 1))).astype(np.float32))


@dataclass
class LanguageModel:
    """Log frequencies per language: of whole words under 0 in `tables`, of n-grams under n."""

    langs: list[str]
    priors: np.ndarray
    tables: dict[int, LogTable] = field(default_factory=dict)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the log frequency by language, for unseen words the mean over their longest known n-grams, and whether it is known.

        A word is known if it was seen in training, or the MIN_KNOWN share of its n-grams of length KNOWN_GRAM.
        """
        scores, known = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        if not self.tables or not words:
            return scores, known
        rows = self.tables[0].find(np.array(word_hashes(words), np.uint64))
        seen = rows >= 0
        scores[seen], known[seen] = self.tables[0].logs[rows[seen]], True
        left = np.flatnonzero(~seen)
        for n in GRAMS:
            if not len(left):
                break
            found, all_of, sums = self._grams([words[i] for i in left], n)
            hit = found > 0
            scores[left[hit]] = sums[hit] / found[hit, None]
            if n >= KNOWN_GRAM:  # shorter ones are reached only without any known n-gram of this length
                share, total = (found, all_of) if n == KNOWN_GRAM else self._grams([words[i] for i in left[hit]], KNOWN_GRAM)[:2]
                at = left if n == KNOWN_GRAM else left[hit]
                known[at] = (total > 0) & (share >= MIN_KNOWN * total)
            left = left[~hit]
        return scores, known

    def _grams(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the number of its known n-grams, of all of them, and the sum of the known ones' logs."""
        hashes, word = gram_windows(words, n)
        rows = self.tables[n].find(hashes) if n in self.tables else np.full(len(hashes), -1)
        on = rows >= 0
        logs = self.tables[n].logs[rows[on]] if on.any() else np.zeros((0, len(self.langs)), np.float32)
        sums = np.stack([np.bincount(word[on], logs[:, k], len(words)) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(words), 0))
        return np.bincount(word[on], minlength=len(words)), np.bincount(word, minlength=len(words)), sums

    def word_score(self, word: str) -> np.ndarray:
        return self.score_words([word])[0][0]


def table_rows(lang: list[str], words: list[str], n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(0 or n-gram length, hashes, index of the language among sorted(set(lang)), counts) of counted words."""
    of = {x: i for i, x in enumerate(sorted(set(lang)))}
    lang_at = np.array([of[x] for x in lang], np.int64)
    yield 0, np.array(word_hashes(words), np.uint64), lang_at, n
    for size in GRAMS:
        hashes, word = gram_windows(words, size)
        yield size, hashes, lang_at[word], n[word]


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted words (lang, word, n) to counted hashes (size, hash, lang, n) of the words and of their n-grams, summed within a batch."""
    for b in batches:
        lang, words, n = b["lang"].to_pylist(), b["word"].to_pylist(), b["n"].to_numpy()
        names = sorted(set(lang))
        for size, hashes, lang_at, counts in table_rows(lang, words, n):
            for k, name in enumerate(names):
                own = lang_at == k
                distinct, at = np.unique(hashes[own], return_inverse=True)
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, at, counts[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), size), pa.int32()), pa.array(distinct.view(np.int64), pa.int64()), pa.array([name] * len(distinct), pa.string()), pa.array(total, pa.int64())], names=["size", "hash", "lang", "n"])


def _priors(langs: list[str], doc_counts: dict[str, int]) -> np.ndarray:
    docs = np.array([doc_counts[x] for x in langs], float)
    return np.log((docs + 1) / (docs.sum() + len(langs)))


def fit_counts(rows: Iterable[tuple[str, str, int]], doc_counts: dict[str, int]) -> LanguageModel:
    """A model from (language, word, count) rows and the number of documents of each language."""
    langs, rows = sorted(doc_counts), list(rows)
    model = LanguageModel(langs, _priors(langs, doc_counts))
    if rows:
        names = sorted({r[0] for r in rows})
        at = np.array([langs.index(x) for x in names])
        for size, hashes, lang_at, n in table_rows([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)):
            distinct, row = np.unique(hashes, return_inverse=True)
            counts = np.zeros((len(distinct), len(langs)), np.int64)
            np.add.at(counts, (row, at[lang_at]), n)
            model.tables[size] = _log_table(distinct, counts)
    return model


def allotted(doc_counts: dict[str, int], max_docs: int) -> dict[str, float]:
    """The share of each language's documents to fit on: as many of each as max_docs allows, all of those that have fewer."""
    left, out = max_docs, {}
    for k, (lang, n) in enumerate(sorted(doc_counts.items(), key=lambda x: x[1])):
        take = min(n, left / (len(doc_counts) - k))
        left -= take
        out[lang] = take / n
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = FIT_DOCS) -> LanguageModel:
    """Learns from rows with a language and a text: all of them up to max_docs, else a hash sample of about that many.

    max_docs is the only bound. The sample takes evenly from the languages, and all documents of a language that has few. All
    words of the sampled whole texts and all n-grams of those words are counted on the executors; the driver gets one row for
    each distinct hash. Priors come from all labelled rows. Rows without language or text are left out; without any, the model
    has no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    docs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(docs)
    model = LanguageModel(langs, _priors(langs, docs))
    if not langs:
        return model
    if sum(docs.values()) > max_docs:
        share = F.lit(0)
        for lang, part in allotted(docs, max_docs).items():
            share = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * part))).otherwise(share)
        rows = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("language")), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def out():
            flat = [(x, w, c) for x, ws in found.items() for w, c in ws.items()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                found[lang].update(words_of(text))
                if sum(map(len, found.values())) > 100_000:
                    yield out()
                    found.clear()
        yield out()

    words = rows.select("lang", "text").mapInArrow(count, _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]
    found = words.mapInArrow(_hash_rows, _HASHES).groupBy("size", "hash").agg(*sums).toArrow()
    sizes, hashes = found["size"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
    for size in np.unique(sizes).tolist():
        on = sizes == size
        counts = np.stack([found[f"n{k}"].to_numpy()[on] for k in range(len(langs))], axis=1)
        model.tables[size] = _log_table(hashes[on], counts)
    return model


class Scorer:
    """Predicts batches of texts; scores of white-space tokens are remembered, up to a limit."""

    def __init__(self, model: LanguageModel, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.vectors = Growing(float, (len(self.model.langs) + 2,))  # a chunk's summed scores, known words and words

    def learn(self, chunks: list[str]) -> None:
        found = list(map(words_of, chunks))
        words = list(dict.fromkeys(w for ws in found for w in ws))
        at = {w: i for i, w in enumerate(words)}
        scores, known = self.model.score_words(words)
        chunk = np.repeat(np.arange(len(chunks)), [len(ws) for ws in found])
        word = np.fromiter((at[w] for ws in found for w in ws), np.int64, len(chunk))
        made = np.zeros((len(chunks), len(self.model.langs) + 2))
        np.add.at(made, chunk, np.concatenate([scores, known[:, None], np.ones((len(words), 1))], axis=1)[word])
        self.rows.update(zip(chunks, range(len(self.rows), len(self.rows) + len(chunks)), strict=True))
        self.vectors.extend(made)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Per text the sum of its words' scores by language, then its known words and its words. Equal texts have equal sums."""
        if len(self.rows) > self.limit:
            self.reset()
        docs = [t.split() if t else [] for t in texts]
        chunks, sizes = [c for d in docs for c in d], np.array([len(d) for d in docs], np.int64)
        out = np.zeros((len(texts), len(self.model.langs) + 2))
        if chunks:
            self.learn(list({c: None for c in chunks if c not in self.rows}))
            ids = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            out[sizes > 0] = np.add.reduceat(self.vectors.view()[ids], starts, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray]:
        """Of each text the language, its posterior, and the share of its words that the model knows."""
        model = self.model
        if not model.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts), np.zeros(len(texts))
        sums = self.sums(texts)
        total = sums[:, :-2] + model.priors
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best, words = p.argmax(axis=1), sums[:, -1]
        scores = np.where(words > 0, p[np.arange(len(p)), best], 0.0)
        return [model.langs[b] if k else "und" for b, k in zip(best, words > 0, strict=True)], scores.tolist(), sums[:, -2] / np.maximum(words, 1)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with `lang_pred` and `score` (posterior probability of that language) added, names prefixed by `prefix`.

    `und` with score 0.0 where the text is null, empty or has no letter, and for every text if the model has no language.
    Ties go to the language first in order of name. Equal texts get equal rows; texts of any length are scored whole. Empty
    tables give no rows; columns of the added names are replaced.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    kept = docs.drop(*names)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, `{names[0]}` string, `{names[1]}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts, langs, scores = b[text_col].to_pylist(), [], []
            for i, j in steps(texts):
                x, y, _ = scorer.predict(texts[i:j])
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(id_crc(F.col("doc_id")), F.lit(5)) != 0)


def reject_unknown(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, min_known: float = MIN_KNOWN) -> DataFrame:
    """The documents whose language is known: undetermined texts go, and those of which the model knows less than min_known of the words.

    The share of known words depends on neither priors nor length. Where it suffices, the language must also have min_score
    when all languages are equally likely beforehand, so that no decision follows the mix of the corpus. Texts that are null,
    empty or without letters go; a model without languages rejects all. Rows are judged by their text alone, so that repeated
    rows and rows without an id fare alike; an empty table gives no rows; all columns pass through, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, priors=np.zeros(len(model.langs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts, kept = b["text"].to_pylist(), []
            for i, j in steps(texts):
                langs, scores, known = scorer.predict(texts[i:j])
                kept += [x != "und" and s >= min_score and k >= min_known for x, s, k in zip(langs, scores, known.tolist(), strict=True)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
