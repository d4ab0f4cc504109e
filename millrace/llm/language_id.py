"""Language identification by a mixture over languages.

Each language has a table of letter-trigram likelihoods.  A word's likelihood in
a language is the product over its trigrams (its boundaries count as letters);
expectation-maximisation over a document's words estimates the proportions of
the languages in it.  The set of languages is then chosen by penalised
likelihood: languages are added in order of their proportion while the
log-likelihood grows by more than the penalty.

Fitting reads at most about ``fit_rows`` documents a language (chosen by a hash
of their text, whole texts, copies once); everything else covers all documents.

Defined results: ``und`` with score 0 for null texts and texts without a letter,
and for all texts if nothing was learned; rows with a null language teach
nothing; repeated rows give equal rows; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BUCKETS = 1 << 16
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter byte's trigram, first byte of each word, words before each text, texts' bytes)."""
    raw, offsets = tv.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    letter = _LETTER[raw]
    b = np.where(letter, raw, 32).astype(np.uint32)
    before, after = np.empty_like(b), np.empty_like(b)
    if len(b):
        before[1:], before[0] = b[:-1], 32
        after[:-1], after[-1] = b[1:], 32
        starts = offsets[:-1][np.diff(offsets) > 0]
        before[starts] = 32
        after[starts[1:] - 1] = 32
    code = ((before << 16) | (b << 8) | after)[letter]
    begin = (before == 32)[letter]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    word = np.flatnonzero(begin)
    first_letter = np.concatenate([[0], np.cumsum(letter)])[offsets]
    return bucket, word, np.searchsorted(word, first_letter), offsets


def _count(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in tv.sliced(batches):
            bucket, word, first, _ = _trigrams(batch.column(1))
            lang = np.array([place[x] for x in batch.column(0).to_pylist()])
            ends = np.append(word, len(bucket))[first]
            own = np.repeat(lang, np.diff(ends))
            total += np.bincount(own * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(total.ravel()[at])], ["lang", "bucket", "n"])

    return run


@dataclass
class Model:
    langs: list[str]
    log_likelihood: np.ndarray  # BUCKETS x languages, float32


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2000, smoothing: float = 0.5) -> Model:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / sizes[lang]))).otherwise(share)
    # copies of a text count once, so that a hot text can't outgrow the sample
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("t"), 11) / F.lit(float(1 << 53)) < share).dropDuplicates(["lang", "t"])
    rows = chosen.mapInArrow(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["bucket"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    probable = (counts + smoothing) / (counts.sum(axis=0) + smoothing * 2 * seen)
    return Model(langs, np.log(probable).astype(np.float32))


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[i]..first[i + 1] - 1; zero for none."""
    out = np.zeros((len(first) - 1, *x.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(first))
    if full.size:
        out[full] = np.add.reduceat(x, first[:-1][full], axis=0)
    return out


def mixtures(model: Model, column: pa.Array, rounds: int = 6, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(has a letter, proportions over all languages, proportions over the chosen set, words) of each text."""
    bucket, word, first, _ = _trigrams(column)
    n, k = len(column), len(model.langs)
    words = np.diff(first)
    if not len(word) or not k:
        return np.zeros(n, dtype=bool), np.zeros((n, k)), np.zeros((n, k)), words
    like = np.add.reduceat(model.log_likelihood[bucket], word, axis=0)
    top = like.max(axis=1, keepdims=True)
    like = np.exp(like - top)  # relative to the best language; its scale is the same for every set of languages
    doc = np.repeat(np.arange(n), words)

    def em(share: np.ndarray, rows: np.ndarray, a: np.ndarray, at: np.ndarray, of: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(np.diff(at), 1)[:, None]
        for _ in range(times):
            r = share[of].astype(np.float32) * a
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
            share = _sum(r, at) / count
        fit_ = _sum(np.log(np.maximum((share[of].astype(np.float32) * a).sum(axis=1), 1e-30)), at)
        return share, fit_

    start = np.full((n, k), 1.0 / k)
    full, _ = em(start, np.arange(n), like, first, doc, rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    chosen = np.where(rank == 0, 1.0, 0.0)
    best = _sum(np.log(np.maximum(like[np.arange(len(like)), order[doc, 0]], 1e-30)), first)
    active = np.flatnonzero(words > 1)
    for size in range(2, k + 1):
        active = active[full[active, order[active, size - 1]] > 1e-3]
        if not active.size:
            break
        pick = np.isin(doc, active)
        at = np.concatenate([[0], np.cumsum(words[active])])
        of = np.repeat(np.arange(len(active)), words[active])
        share = np.where(rank[active] < size, np.maximum(full[active], 1e-6), 0.0)
        share /= share.sum(axis=1, keepdims=True)
        share, fit_ = em(share, active, like[pick], at, of, 3)
        better = fit_ - best[active] > penalty * (1 + np.log(np.maximum(words[active], 2)))
        active, share, fit_ = active[better], share[better], fit_[better]
        chosen[active], best[active] = share, fit_
    return words > 0, full, chosen, words


def _has_letter(column: pa.Array) -> np.ndarray:
    raw, offsets = tv.buffers(column)
    raw = raw[offsets[0] : offsets[-1]]
    ascii_ = np.concatenate([[0], np.cumsum((_LETTER & (np.arange(256) < 128))[tv.LOWER[raw]])])
    at = offsets - offsets[0]
    out = ascii_[at[1:]] > ascii_[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)).tolist():
        out[i] = any(map(str.isalpha, column[i].as_py()))
    return out


def _infer(model: Model, column: pa.Array, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the predicted language, with `und` after the last; proportions over all languages, over the chosen set; words) of each text."""
    _, full, chosen, words = mixtures(model, column, penalty=penalty)
    known = _has_letter(column) & (words > 0) if model.langs else np.zeros(len(column), dtype=bool)
    return np.where(known, chosen.argmax(axis=1) if model.langs else 0, len(model.langs)), full, chosen, words


def _predict(model: Model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in tv.sliced(batches, most=1 << 20):
            column = batch.column(1).fill_null("")
            lang, full, chosen, words = _infer(model, column, penalty)
            known = lang < len(model.langs)
            # proportion with half a word's worth of doubt for each language
            k = max(1, len(model.langs))
            sure = (full * words[:, None] + 0.5) / (words[:, None] + 0.5 * k) if model.langs else np.zeros((len(column), 1))
            score = np.where(known, sure[np.arange(len(column)), np.where(known, lang, 0)], 0.0)
            said = [",".join(f"{model.langs[j]}:{chosen[i, j]:.3f}" for j in np.argsort(-chosen[i], kind="stable") if chosen[i, j] > 0) if known[i] else "" for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[lang].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(said, pa.string())], ["key", "lang_pred", "score", "languages"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """One row per document: id, lang_pred, score, languages (the chosen mixture)."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t")).mapInArrow(_predict(model, penalty), f"key {kind}, lang_pred string, score double, languages string")
    return out.withColumnRenamed("key", id_col)


def _recognised(model: Model, place: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches, place, 1 << 20):
            lang, *_ = _infer(model, batch.column(place).fill_null(""), penalty)
            yield batch.filter(pa.array(lang < len(model.langs)))

    return run


def recognised(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """The documents whose language, inferred as `predict` does, isn't ``und``, with all their columns; texts stay where they are."""
    return docs.mapInArrow(_recognised(model, docs.columns.index(text_col), penalty), docs.schema)


def _accepted(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.sliced(batches, place, 1 << 20):
            yield batch.filter(pa.array(_has_letter(batch.column(place).fill_null(""))))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `recognised` by a plainer test, a letter alone, so no mixture is inferred; if nothing was learned, none is left."""
    return docs.mapInArrow(_accepted(docs.columns.index(text_col)), docs.schema) if model.langs else docs.limit(0)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True where crc32 of the id as text falls into the fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
