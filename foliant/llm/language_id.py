"""Language identification by interpolated Kneser-Ney character models, one per language.

The models are n-grams of characters inside words, each word begun and ended by a space. All languages share sorted
arrays of n-gram hashes; beside each hash stand, per language, the interpolated log probability of its last character
and the log weight of backing off from it as a context. A text goes to the language with the lowest cross-entropy per
character. Rejection is calibrated on labelled texts: what fits its best language much worse than nearly all of them
do is not accepted. How much better it fits than another language is the score, by which nothing is rejected: mixed
texts and such of unlearned languages are accepted where their cross-entropy is low enough.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, tidy

ORDER, DISCOUNT = 4, 0.75
#: About so many labelled documents of each language are learned from, and so many more calibrate the rejection.
FIT_DOCS, CALIBRATION_DOCS = 1500, 500
#: Languages that are learned, at most: those with the most documents.
MOST_LANGUAGES = 256
#: Part of the calibration texts that may lie beyond the limit before its margin is added, and that margin.
TAIL, MARGIN = 0.002, 0.25
#: Bytes of text scored at once, about: each different word of them is scored once.
SLICE_BYTES = 2 << 20
UNKNOWN = "und"
_FLOOR = -12.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words (runs of letters) of all texts, and how many each text has. A null text has none."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "")
    if not pc.all(full).as_py():  # an empty text splits into one empty word
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = full.to_numpy(zero_copy_only=False)
        counts = np.bincount(owner[keep], minlength=len(counts))
        words = words.filter(full)
    return words, counts


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, each with a space before and after it, in one array, and the words' lengths there."""
    joined = " " + "  ".join(words.to_pylist()) + " " if len(words) else ""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), lengths


def gram_hashes(chars: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n-gram that ends at each place; 0 where it would begin in another word."""
    place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, h = [], np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        mixed = (chars + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        for n in range(1, order + 1):
            part = np.zeros_like(h)
            part[n - 1 :] = mixed[: len(chars) - n + 1]
            h = (h + part * np.uint64(2 * n + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            out.append(np.where(place >= n - 1, h | np.uint64(1), np.uint64(0)))
    return out


class KneserNey:
    """Models of several languages, fitted from counts of words, and their lookups."""

    def __init__(self, order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.discount, self.languages = order, discount, []

    def fit(self, counts: dict[str, Counter]) -> KneserNey:
        self.languages = sorted(counts)
        parts = [self._one(counts[x]) for x in self.languages]
        self.keys, self.prob, self.back = [], [], []
        for n in range(self.order):
            keys = np.unique(np.concatenate([p[n][0] for p in parts]))
            prob = np.full((len(keys), len(parts)), np.nan, np.float32)
            back = np.zeros((len(keys), len(parts)), np.float32)
            for k, p in enumerate(parts):
                at = np.searchsorted(keys, p[n][0])
                prob[at, k], back[at, k] = p[n][1], p[n][2]
            self.keys.append(keys)
            self.prob.append(prob)
            self.back.append(back)
        return self

    def _one(self, counts: Counter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each order: n-gram hashes, log probabilities, log back-off weights."""
        words = pa.array(list(counts), pa.string())
        chars, lengths = characters(words)
        weight = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), lengths)
        grams = gram_hashes(chars, lengths, self.order)
        inside = np.arange(len(chars)) != np.repeat(np.cumsum(lengths) - lengths, lengths)  # the first space is context only
        d, tables = self.discount, []
        for n in range(self.order):
            ok = (grams[n] > 0) & inside
            keys, first, where = np.unique(grams[n][ok], return_index=True, return_inverse=True)
            places = np.nonzero(ok)[0]
            rows = places[first]
            context = grams[n - 1][rows - 1] if n else np.zeros(len(rows), np.uint64)
            suffix = grams[n - 1][rows] if n else None
            tables.append((keys, np.bincount(where, weight[places], len(keys)), context, suffix))
        out, below = [], None
        for n in range(self.order):
            keys, raw, context, _ = tables[n]
            if n + 1 < self.order:  # continuation counts: distinct characters that come before
                longer = tables[n + 1]
                count = np.zeros(len(keys))
                at = np.minimum(np.searchsorted(keys, longer[3]), len(keys) - 1)
                np.add.at(count, at, 1.0)
                count = np.where(count > 0, count, np.minimum(raw, 1.0))  # n-grams that only begin a word
            else:
                count = raw
            contexts, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, count, len(contexts))
            kinds = np.bincount(which, minlength=len(contexts))
            share = d * kinds / total
            if n:
                lower = np.searchsorted(below[0], tables[n][3])
                p = np.maximum(count - d, 0) / total[which] + share[which] * below[1][lower]
            else:
                p = np.maximum(count - d, 0) / total[which] + share[which] / 5000.0
            if n:  # back-off weights belong to the n-grams one shorter
                back = np.zeros(len(below[0]))
                at = np.searchsorted(below[0], contexts)
                hit = (at < len(below[0])) & (below[0][np.minimum(at, len(below[0]) - 1)] == contexts)
                back[at[hit]] = np.log(share[hit])
                out.append((below[0], np.log(below[1]), back))
                # a word's first space is never predicted, yet it is a context
                extra = ~hit
                if extra.any():
                    k, pr, b = out[-1]
                    order_ = np.argsort(np.concatenate([k, contexts[extra]]), kind="stable")
                    out[-1] = (
                        np.concatenate([k, contexts[extra]])[order_],
                        np.concatenate([pr, np.full(extra.sum(), np.nan)])[order_],
                        np.concatenate([b, np.log(share[extra])])[order_],
                    )
            below = (keys, p)
        out.append((below[0], np.log(below[1]), np.zeros(len(below[0]))))
        return out

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of words (a row each, a column per language), and their predicted characters."""
        chars, lengths = characters(words)
        if not len(chars):
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        total, previous = None, None
        for n, grams in enumerate(gram_hashes(chars, lengths, self.order)):
            keys = self.keys[n]
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = keys[at] == grams
            prob = np.where(hit[:, None], self.prob[n][at], np.float32(np.nan))
            if n == 0:
                total = np.where(np.isnan(prob), np.float32(_FLOOR), prob)
            else:
                backed = total.copy()
                backed[1:] += previous[:-1]
                total = np.where(np.isnan(prob), backed, prob)
            previous = np.where(hit[:, None], self.back[n][at], np.float32(0))
        starts = np.cumsum(lengths) - lengths
        total[starts] = 0
        return np.add.reduceat(total, starts, axis=0, dtype=np.float64), lengths - 1

    def entropies(self, texts: pa.Array) -> np.ndarray:
        """Cross-entropy per character of each text by language, in nats; nan for texts without letters."""
        words, counts = word_arrays(texts)
        coded = words.dictionary_encode()
        score, size = self.score(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        out = np.full((len(counts), len(self.languages)), np.nan)
        full = np.nonzero(counts)[0]
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            sums = np.stack([np.add.reduceat(score[index, k], starts) for k in range(len(self.languages))], axis=1)
            out[full] = -sums / np.add.reduceat(size[index], starts)[:, None]
        return out


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a batch of texts by about SLICE_BYTES, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


class LanguageModel:
    """Kneser-Ney models with calibrated limits."""

    def __init__(self, models: KneserNey):
        self.models = models
        self.limit = np.full(len(models.languages), np.inf)
        self.scale = 1.0

    def calibrate(self, h: np.ndarray, langs: list[str]) -> LanguageModel:
        """h: entropies of labelled texts, a row each; langs: their languages."""
        if not self.models.languages or not len(h):
            return self
        known = {x: k for k, x in enumerate(self.models.languages)}
        truth = np.array([known.get(x, -1) for x in langs])
        ok = ~np.isnan(h[:, 0]) & (truth >= 0)
        for k in range(len(known)):
            own = h[ok & (truth == k), k]
            if len(own):
                self.limit[k] = np.quantile(own, 1 - TAIL) * (1 + MARGIN)
        if ok.any() and len(known) > 1:  # the scale of the score under which the labelled texts are likeliest
            scales = np.geomspace(1, 64, 25)
            gap = h[ok] - h[ok].min(axis=1, keepdims=True)
            cost = [np.mean(np.log(np.exp(-s * gap).sum(axis=1)) + s * gap[np.arange(ok.sum()), truth[ok]]) for s in scales]
            self.scale = float(scales[int(np.argmin(cost))])
        return self

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its share among the languages, 0 to 1) and whether it is accepted."""
        if not self.models.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h = self.models.entropies(texts)
        none = np.isnan(h[:, 0])
        best = np.where(none[:, None], 0.0, h).argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp(-self.scale * (np.where(none[:, None], 0.0, h) - np.where(none, 0.0, low)[:, None])).sum(axis=1)
        score[none] = 0
        names = np.array([*self.models.languages, UNKNOWN])[np.where(none, len(self.models.languages), best)]
        return names.tolist(), score, ~none & (np.where(none, np.inf, low) <= self.limit[best])


def fit_languages(docs: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learns from the documents (doc_id, text, lang) that are not held out and have a language.

    From each language about fit_docs + calibration_docs of them are drawn by a hash of doc_id, whole texts: a bounded
    sample. Of more than most_languages values of lang those with the most documents are learned, of equal ones the first
    by name: a column that holds other things than languages costs no more. Executors count the sample's words; the driver gets those counts and fits arrays from them.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    supported = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in supported.collect()}
    if not sizes:
        return LanguageModel(KneserNey())
    drawn = fit_docs + calibration_docs
    part = (F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / (1 << 40)).cast("double")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, drawn / n))])[F.col("lang")]
    sample = known.where(F.col("lang").isin(*sizes)).where(part < share).select("text", "lang", (part < share * fit_docs / drawn).alias("fits"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(1)).to_pylist():
                words, _ = word_arrays(batch.column(0).filter(pc.equal(batch.column(1), lang)))
                each = words.value_counts()
                found.setdefault(lang, Counter()).update(dict(zip(each.field("values").to_pylist(), each.field("counts").to_pylist())))
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    counted = sample.where("fits").select("text", "lang").mapInArrow(tidy(count), "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {x: Counter() for x in counted.column("lang").unique().to_pylist()}
    for lang, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts[lang][word] = n
    models = KneserNey().fit(counts) if counts else KneserNey()
    if not models.languages:
        return LanguageModel(models)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                h = shared.value.entropies(batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(list(h), pa.list_(pa.float64()))], names=["lang", "h"])

    # executors read the texts; the driver gets a few numbers of about calibration_docs texts a language
    test = sample.where(~F.col("fits")).select("text", "lang").mapInArrow(tidy(measure), "lang string, h array<double>").toArrow()
    h = np.array(test.column("h").to_pylist(), np.float64).reshape(-1, len(models.languages))
    return LanguageModel(models).calibrate(h, test.column("lang").to_pylist())


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and accepted added (columns of these names are replaced, whatever their case).

    Only texts go to Python, and only the three results come back. A text that is null, empty or has no letter is `und`,
    score 0, not accepted; so is every text if nothing was learned. Of languages that fit equally well the first by name
    is taken. Texts are scored whole, whatever their length, and rows that repeat are scored each on its own; no other
    column is read, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.predict(texts.slice(lo, hi - lo)) for lo, hi in slices(texts)]
            names = [x for p in parts for x in p[0]]
            score, accepted = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted.astype(bool))], names=["lang_pred", "score", "accepted"])

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(predict)(batches)

    found = F.arrow_udf(found, "struct<lang_pred string, score double, accepted boolean>")
    added = ("lang_pred", "score", "accepted")
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in added]
    return docs.select(*kept, found("text").alias("_found")).select(*kept, *[F.col("_found")[c].alias(c) for c in added])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs)
    # only doc_id and text reach the prediction
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
