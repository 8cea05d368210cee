"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over the characters of words (start and end marked) up to order
``ORDER``.  The models are fitted on a bounded sample of labelled documents per language, merged
into sorted hash arrays with one column per language, and every document takes the language of
the lowest cross-entropy per character.  A document is rejected if even that is above the
language's threshold, calibrated on labelled documents that the judging model was not fitted on.

The threshold is a high quantile of the held documents' cross-entropy less the allowance for short
texts, plus a slack; the allowance is added again when a text is judged.  Languages with few
documents are judged by models that each leave a third of them out.  A language without a rightly
judged held document takes the quantile over all languages.

Only letters count: text is lowered, ASCII characters other than letters separate words.

Defined results: a null text and a text without a letter are ``und`` with score 0.0 and rejected;
without any labelled document everything is ``und``; if not one held document can be judged (a
single word in all) nothing is rejected for its cross-entropy; repeated rows give a row each; extra columns
are kept or ignored as asked; an empty table gives no rows; a null doc_id is never learned from; of rows with one doc_id and language one text is learned from, the least.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acclaim.llm.common import by_size, prepare, stage

ORDER = 5
#: labelled documents per language that the models are fitted on, at most
FIT_DOCUMENTS = 400
#: further labelled documents per language that the rejection is calibrated on, at most
CALIBRATION_DOCUMENTS = 200
#: characters of a language's sample, at most: documents of higher rank stay out once it is reached
SAMPLE_CHARACTERS = 50_000_000
#: characters that a model holds possible, for the uniform distribution below order 1
ALPHABET = 10_000
#: share of the held documents that the threshold covers without slack
QUANTILE = 0.98
#: cross-entropy (bits) allowed above that quantile, and more for texts of few characters
SLACK, SHORT_SLACK = 1.0, 8.0
#: a language with fewer held documents is calibrated by leaving out one of ``FOLDS`` parts after the other
FEW_HELD, FOLDS = 30, 3
#: languages whose sizes are sent to every task
MOST_GROUPS = 10_000
#: words whose scores a worker keeps
CACHED_WORDS = 150_000

UNKNOWN = "und"
_START, _END = "\x02", "\x03"
_LETTER = re.compile(r"[^\W\d_]")
_SEPARATE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def _gram_hashes(words: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every predicted character: hashes of the grams that end in it (orders 1..n) and of their contexts; its word."""
    pad = _START * (order - 1)
    joined = "".join(f"{pad}{w.decode('utf-8', 'surrogatepass')}{_END}" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.flatnonzero(codes != ord(_START))
    word = np.cumsum(codes == ord(_END))[at] - (codes[at] == ord(_END))
    grams, contexts = [], []
    for n in range(1, order + 1):
        h = np.full(at.size, n, np.uint64)
        for back in range(n - 1, 0, -1):
            h = (h ^ codes[at - back]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        contexts.append(h)
        h = (h ^ codes[at]) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append(h ^ (h >> np.uint64(32)))
    return grams, contexts, word


@dataclass
class Models:
    """Log2 probabilities per order: sorted gram hashes with a column per language, and sorted contexts' back-off weights."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_backoff: list[np.ndarray]
    thresholds: np.ndarray

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log2 probability per word and language, predicted characters per word)."""
        grams, contexts, word = _gram_hashes(words, self.order)
        total = np.zeros((word.size, len(self.languages)))
        waiting = np.arange(word.size)
        for n in range(self.order, 0, -1):
            if not waiting.size:
                break
            keys, wanted = self.grams[n - 1], grams[n - 1][waiting]
            found = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
            hit = keys[found] == wanted
            total[waiting[hit]] += self.log_p[n - 1][found[hit]]
            waiting = waiting[~hit]
            keys, wanted = self.contexts[n - 1], contexts[n - 1][waiting]
            found = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
            hit = keys[found] == wanted
            total[waiting[hit]] += self.log_backoff[n - 1][found[hit]]
        total[waiting] -= math.log2(ALPHABET)
        sums = np.zeros((len(words), len(self.languages)))
        for i in range(len(self.languages)):
            sums[:, i] = np.bincount(word, weights=total[:, i], minlength=len(words))
        return sums, np.bincount(word, minlength=len(words))


def _counts_per(keys: np.ndarray, lang: np.ndarray, rows: np.ndarray, weight: np.ndarray, languages: int) -> np.ndarray:
    out = np.zeros((keys.size, languages))
    np.add.at(out, (rows, lang), weight)
    return out


def kneser_ney(lang: np.ndarray, count: np.ndarray, grams: list[np.ndarray], contexts: list[np.ndarray], languages: list[str]) -> Models:
    """Models from the distinct highest-order grams of each language.

    ``grams[n]`` and ``contexts[n]`` hold, for every row, the hash of its gram of order n + 1 and of
    that gram's context.  Below the highest order a gram counts the distinct grams it ends.
    """
    order, size = len(grams), len(languages)
    tables = []
    rows, weight = np.arange(lang.size), count.astype(float)
    for n in range(order, 0, -1):
        tables.append((n, rows, weight))
        if n > 1:
            keys = np.stack([lang[rows].astype(np.uint64), grams[n - 2][rows]])
            _, first, times = np.unique(keys, axis=1, return_index=True, return_counts=True)
            rows, weight = rows[first], times.astype(float)
    model = Models(languages, order, [], [], [], [], np.full(size, np.inf))
    below_keys, below = None, None
    for n, rows, weight in reversed(tables):
        here = lang[rows]
        keys, first, row_of = np.unique(grams[n - 1][rows], return_index=True, return_inverse=True)
        c = _counts_per(keys, here, row_of, weight, size)
        context_keys, context_of = np.unique(contexts[n - 1][rows], return_inverse=True)
        totals = _counts_per(context_keys, here, context_of, weight, size)
        types = _counts_per(context_keys, here, context_of, np.ones(rows.size), size)
        once = np.array([(weight[here == i] == 1).sum() for i in range(size)], float)
        twice = np.array([(weight[here == i] == 2).sum() for i in range(size)], float)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.05, 0.95)
        backoff = np.where(totals > 0, discount * types / np.maximum(totals, 1), 1.0)
        context = context_of[first]
        lower = np.full((keys.size, size), 1.0 / ALPHABET) if below is None else below[np.searchsorted(below_keys, grams[n - 2][rows[first]])]
        p = np.maximum(c - discount, 0) / np.maximum(totals[context], 1) + backoff[context] * lower
        model.grams.append(keys)
        model.log_p.append(np.log2(p).astype(np.float32))
        model.contexts.append(context_keys)
        model.log_backoff.append(np.log2(backoff).astype(np.float32))
        below_keys, below = keys, p
    return model


def _lowest_ranks(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Up to ``most`` ids per group in the order of ``_hash``; an id counts once, however many rows it has.

    Each group is first thinned to about twice as many by its own size, so no ranking sees a large group and
    no id moves before that.
    """
    sizes = rows.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("_n"))
    # a row per group; only where there are very many groups they are left to a shuffle
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_GROUPS else sizes
    share = F.pmod("_hash", F.lit(1 << 40)) / float(1 << 40)
    thinned = rows.join(sizes, group).withColumn("_share", share).filter(F.col("_share") * F.col("_n") < 2 * most + 100).drop("_n").distinct()
    return thinned.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_share", "doc_id"))).filter(F.col("_rank") <= most)


def fit(docs: DataFrame, labelled: Column, order: int = ORDER, fit_documents: int = FIT_DOCUMENTS, calibration_documents: int = CALIBRATION_DOCUMENTS) -> Models | None:
    """Models from documents where ``labelled`` holds and text and lang are not null; None if there are none."""
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.filter(labelled & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = usable.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("_hash"))
    chosen = _lowest_ranks(ids, "lang", fit_documents + calibration_documents).select("doc_id", F.col("lang").alias("_lang"), "_rank")
    chosen = stage(chosen, "language-sample")
    apart = F.col("_rank") * calibration_documents % (fit_documents + calibration_documents) < calibration_documents
    sizes = {r["_lang"]: (r["n"], r["held"]) for r in chosen.groupBy("_lang").agg(F.count("*").alias("n"), F.count_if(apart).alias("held")).orderBy("_lang").collect()}
    languages = list(sizes)
    if not languages:
        return None
    few = F.col("_lang").isin([x for x, (_, held) in sizes.items() if held < FEW_HELD])
    # too few documents for a part each: every document is cut into parts
    cut = F.col("_lang").isin([x for x, (n, _) in sizes.items() if n < FOLDS])
    # at most (fit + calibration) rows per language
    sample = usable.join(F.broadcast(chosen), "doc_id").filter(F.col("lang") == F.col("_lang"))
    sample = sample.groupBy("doc_id", "lang", "_lang", "_rank").agg(F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    sample = sample.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < SAMPLE_CHARACTERS)
    sample = sample.withColumn("_part", F.explode(F.when(cut, F.sequence(F.lit(0), F.lit(FOLDS - 1))).otherwise(F.array(F.lit(0)))))
    size = F.ceil(F.length("text") / FOLDS).cast("int")
    part = F.when(cut, F.substr("text", F.col("_part") * size + 1, size)).otherwise(F.col("text"))
    # -1: fitted on always, FOLDS: held always, otherwise the fold that leaves it out
    fold = F.when(few, (F.col("_rank") + F.col("_part")) % FOLDS).otherwise(F.when(apart, F.lit(FOLDS)).otherwise(F.lit(-1))).cast("int")
    sample = stage(sample.select("lang", part.alias("text"), fold.alias("_fold")), "language-texts")
    number = {language: i for i, language in enumerate(languages)}
    names = [f"g{n}" for n in range(1, order + 1)] + [f"x{n}" for n in range(1, order + 1)]
    longs = ", ".join(f"{n} long" for n in names)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()])
            folds = batch.column(2).to_numpy()
            for low, high in by_size(texts):
                words = [words_of(t) for t in texts[low:high]]
                grams, contexts, word = _gram_hashes([w for ws in words for w in ws], order)
                of_word = np.repeat(np.arange(low, high), [len(ws) for ws in words])
                if not word.size:
                    continue
                lang, fold = langs[of_word[word]], folds[of_word[word]]
                keys = np.stack([(lang * (FOLDS + 1) + fold + 1).astype(np.uint64), grams[-1]])
                _, first, times = np.unique(keys, axis=1, return_index=True, return_counts=True)
                columns = [pa.array(lang[first].astype(np.int32)), pa.array(fold[first].astype(np.int32)), pa.array(times)] + [pa.array(h[first].astype(np.int64)) for h in (*grams, *contexts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "fold", "c", *names])

    counted = sample.filter(F.col("_fold") < FOLDS).select("text", "lang", "_fold").mapInArrow(count, f"lang int, fold int, c long, {longs}")
    rest = [F.first(n).alias(n) for n in names if n != f"g{order}"]
    in_fold = [F.sum(F.when(F.col("fold") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(FOLDS)]
    counted = counted.groupBy("lang", f"g{order}").agg(F.sum("c").alias("c"), *in_fold, *rest)
    table = counted.select("lang", "c", *[f"c{i}" for i in range(FOLDS)], *names).toArrow()  # distinct grams of the bounded sample
    if not table.num_rows:
        return None

    def fitted(counts: np.ndarray) -> Models:
        used = np.flatnonzero(counts)
        column = lambda name: table.column(name).to_numpy()[used].astype(np.int64).astype(np.uint64)
        grams, contexts = ([column(f"{kind}{n}") for n in range(1, order + 1)] for kind in "gx")
        return kneser_ney(table.column("lang").to_numpy()[used], counts[used], grams, contexts, languages)

    everything = table.column("c").to_numpy()
    model = fitted(everything)
    judged = _judged(sample.filter(F.col("_fold") == FOLDS), model)
    for i in range(FOLDS):
        # what the model of this fold is fitted on; no few documents, no folds
        left = everything - table.column(f"c{i}").to_numpy()
        if left.any() and any(held < FEW_HELD for _, held in sizes.values()):
            judged += _judged(sample.filter(F.col("_fold") == i), fitted(left))
    model.thresholds[:] = thresholds(languages, [(r["lang"], r["lang_pred"], r["_excess"]) for r in judged if r["_excess"] is not None])
    return model


def _judged(held: DataFrame, model: Models) -> list:
    """What a model says of held documents, at most calibration_documents per language; the model leaves the executors."""
    shared = held.sparkSession.sparkContext.broadcast(model)
    found = _identified(held, shared, ("lang",)).collect()
    shared.destroy()
    return found


def thresholds(languages: list[str], judged: list[tuple[str, str, float]]) -> list[float]:
    """The highest excess accepted per language, from (lang, lang_pred, excess) of held documents."""
    right: dict[str, list[float]] = {}
    for lang, predicted, excess in judged:
        if lang == predicted:
            right.setdefault(lang, []).append(excess)
    pooled = [e for es in right.values() for e in es] or [excess for *_, excess in judged]
    return [float(np.quantile(es, QUANTILE)) + SLACK if (es := right.get(x) or pooled) else math.inf for x in languages]


def identify(docs: DataFrame, model: Models | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1), rejected, _bits (the cross-entropy) and _excess (less the allowance for short texts)."""
    prepare(docs.sparkSession)
    return _identified(docs, docs.sparkSession.sparkContext.broadcast(model), keep)


def _identified(docs: DataFrame, shared, keep: tuple[str, ...]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{name}` {types[name]}" for name in keep] + ["lang_pred string, score double, rejected boolean, _bits double, _excess double"])
    names = [*keep, "lang_pred", "score", "rejected", "_bits", "_excess"]
    read = list(keep) if "text" in keep else [*keep, "text"]
    text_at = read.index("text")

    def judge(batches):
        import pyarrow as pa

        model = shared.value
        scorer = _WordScores(model) if model is not None else None
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found: list[tuple] = []
            for low, high in by_size(texts):
                found += scorer.judge(texts[low:high]) if scorer else [(UNKNOWN, 0.0, True, None, None)] * (high - low)
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.float64())
            own = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *own], names=names)

    return docs.select(*read).mapInArrow(judge, schema)


def accepted(docs: DataFrame, model: Models | None) -> DataFrame:
    """The documents that ``identify`` would not reject, with all their columns and no other."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def judge(batches):
        import pyarrow as pa

        scorer = _WordScores(shared.value) if shared.value is not None else None
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            kept = [scorer is not None and not found[2] for low, high in by_size(texts) for found in (scorer.judge(texts[low:high]) if scorer else [None] * (high - low))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


class _WordScores:
    """Scores of words seen by this worker, at most about ``CACHED_WORDS`` of them."""

    def __init__(self, model: Models):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.model.languages)))
        self.sizes = np.zeros(0, np.int64)

    def judge(self, texts: list[str | None]) -> list[tuple]:
        if len(self.index) > CACHED_WORDS:
            self._clear()
        index, known = self.index, len(self.index)
        numbers, counts, letters = [], [], []
        for text in texts:
            words = words_of(text) if text else []
            counts.append(len(words))
            letters.append(bool(text) and _LETTER.search(text) is not None)
            numbers += [index.setdefault(w, len(index)) for w in words]
        if len(index) > known:
            new = list(index)[known:]
            sums, sizes = self.model.score(new)
            self.sums, self.sizes = np.concatenate([self.sums, sums]), np.concatenate([self.sizes, sizes])
        number = np.array(numbers, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        characters = np.bincount(doc, weights=self.sizes[number], minlength=len(texts))
        total = np.stack([np.bincount(doc, weights=self.sums[number, i], minlength=len(texts)) for i in range(self.sums.shape[1])], axis=1)
        bits = -total / np.maximum(characters, 1)[:, None]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        # odds of the others over at most 50 characters, so that the score still tells texts apart
        score = 1.0 / np.exp2(-np.minimum(characters, 50)[:, None] * (bits - least[:, None])).sum(axis=1)
        excess = least - SHORT_SLACK / np.sqrt(np.maximum(characters, 1))
        rejected = excess > self.model.thresholds[best]
        return [
            (self.model.languages[b], float(s), bool(r), float(e), float(x)) if has else (UNKNOWN, 0.0, True, None, None)
            for has, b, s, r, e, x in zip(letters, best, score, rejected, least, excess)
        ]
