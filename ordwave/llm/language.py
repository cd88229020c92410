"""Language identification of texts that may mix languages.

Each language has a distribution over hashed byte n-grams of letters. A document's grams come from a
mixture of languages; expectation maximisation estimates its proportions, and the number of
languages is chosen by penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import mix, slices, utf8

#: n-grams fall into this many classes; a language's model has as many numbers.
CLASSES, GRAM = 1 << 14, 4
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, count) of the byte n-grams of letters in each text; runs of other bytes are one gap."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    b = _FOLD[data]
    gap = b == 32
    text = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(b), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (text[1:] == text[:-1]))
    b, text = b[keep].astype(np.uint64), text[keep]
    if len(b) < GRAM:
        return (np.zeros(0, np.int64),) * 3
    key = np.zeros(len(b) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        key = key * np.uint64(256) + b[j : len(b) - GRAM + 1 + j]
    same = text[: len(key)] == text[GRAM - 1 :]
    owner, cls = text[: len(key)][same], (mix(key[same], 7) % np.uint64(CLASSES)).astype(np.int64)
    both, count = np.unique(owner * CLASSES + cls, return_counts=True)
    return both // CLASSES, both % CLASSES, count


def _lettered(column) -> np.ndarray:
    """Which texts have a letter of any alphabet."""
    return np.array([bool(t) and (any(c.isalpha() for c in t[:64]) or any(c.isalpha() for c in t)) for t in column.to_pylist()], bool)


@dataclass(frozen=True)
class LanguageModel:
    """Sorted languages and the log probability of each gram class in each (languages x CLASSES)."""

    languages: list[str]
    log_p: np.ndarray


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, max_languages: int = 500) -> LanguageModel:
    """Gram counts of every labelled text; rows with a null text or lang are left out.

    Counts are summed in tasks, then by (language, class): at most max_languages * CLASSES numbers
    reach the driver, however many rows there are. More languages than that raise an error. No
    labelled rows: a model without languages.
    """
    source = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                owner, cls, count = grams(batch.column("text"))
                for lang in dict.fromkeys(langs.tolist()):
                    mine = langs[owner] == lang if len(owner) else np.zeros(0, bool)
                    total.setdefault(lang, np.zeros(CLASSES)).__iadd__(np.bincount(cls[mine], count[mine], CLASSES))
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], names=["lang", "cls", "n"])

    sums = source.mapInArrow(run, "lang string, cls int, n long").groupBy("lang", "cls").agg(F.sum("n").alias("n"))
    per_lang = sums.groupBy("lang").agg(F.collect_list(F.struct("cls", "n")).alias("c"))  # CLASSES entries at most
    rows = per_lang.limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    counts = np.zeros((len(rows), CLASSES))
    for i, r in enumerate(rows):
        for x in r["c"]:
            counts[i, x["cls"]] = x["n"]
    counts += smoothing
    return LanguageModel([r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True)))


def _fit(like: np.ndarray, count: np.ndarray, lengths: np.ndarray, pi: np.ndarray, low: np.ndarray | None = None, gap: float = 0.01, move: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (languages x texts) of the largest likelihood, its logarithm, and a bound that no proportions exceed.

    `like` is languages x grams, the grams of a text together (`lengths` of them). Expectation
    maximisation goes on from pi until the log likelihood is within `gap` (or a millionth a gram) of
    its maximum and no proportion moves by more than `move`, however many rounds that takes; a text
    whose maximum lies below `low` ends as soon as that is certain. The likelihood is concave, so its
    maximum exceeds it by size * log(largest gradient) at most.
    """
    out, log_out, top_out = pi.copy(), np.zeros(len(lengths)), np.zeros(len(lengths))
    low = np.full(len(lengths), -np.inf) if low is None else low
    texts, live = np.arange(len(lengths)), np.ones(len(lengths), bool)
    while len(texts):
        begin = np.cumsum(lengths) - lengths
        local = np.repeat(np.arange(len(lengths)), lengths)
        size = np.add.reduceat(count, begin).astype(float)
        while True:
            joint = pi[:, local]
            joint *= like
            total = joint.sum(0)
            log = np.add.reduceat(count * np.log(total), begin)
            np.multiply(like, count / total, out=joint)
            slope = np.add.reduceat(joint, begin, axis=1) / size
            new = pi * slope
            top = log + size * np.log(np.maximum(slope.max(0), 1))
            done = (top - log <= np.maximum(gap, 1e-6 * size)) & (np.abs(new - pi).max(0) <= move)
            done = live & (done | (top <= low))
            if done.any():
                out[:, texts[done]], log_out[texts[done]], top_out[texts[done]] = pi[:, done], log[done], top[done]
                live &= ~done
            pi = new / new.sum(0)
            if 5 * lengths[live].sum() <= 4 * len(local):
                break
        kept = live[local]
        like, count = like[:, kept], count[kept]
        texts, lengths, pi, low = texts[live], lengths[live], pi[:, live], low[live]
        live = live[live]
    return out, log_out, top_out


def mixtures(model: LanguageModel, owner: np.ndarray, cls: np.ndarray, count: np.ndarray, n: int, most: int | None = None, gap: float = 0.01, penalty: float = 4.0) -> np.ndarray:
    """Language proportions of n texts, whose grams are sorted by text: (n x languages), zero outside the chosen set.

    The set of k languages holds those with the largest proportions under all languages; k, up to
    `most` or all, has the largest log likelihood less penalty * k * log(grams). Sets whose score
    cannot be the largest, as the likelihood under all languages shows, are not fitted. Texts
    without grams have zeros.
    """
    k_all = len(model.languages)
    most = k_all if most is None else min(most, k_all)
    p = np.zeros((n, k_all))
    if not len(owner) or not k_all:
        return p
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[begin]
    lengths = np.diff([*begin, len(owner)])
    log_like = model.log_p[:, cls]
    like = np.exp(log_like)
    price = penalty * np.log(np.maximum(np.add.reduceat(count, begin).astype(float), 2))
    alone = np.add.reduceat(log_like * count, begin, axis=1)  # one language: nothing to estimate
    only = alone.argmax(0)
    best = np.zeros((k_all, len(who)))
    best[only, np.arange(len(who))] = 1
    best_score = alone.max(0) - price
    if most > 1:
        full, log, top = _fit(like, count, lengths, (best + 1 / k_all) / 2, best_score + 2 * price, gap)
        order = np.argsort(-full, axis=0, kind="stable")
        for k in range(2, most + 1):
            at = np.flatnonzero(top - k * price > best_score)
            if not len(at):
                break
            names = order[:k, at]
            if k < k_all:
                mine = np.repeat(np.isin(np.arange(len(who)), at), lengths)
                start = np.take_along_axis(full[:, at], names, 0) + 0.001
                pi, found, _ = _fit(like[np.repeat(names, lengths[at], axis=1), np.flatnonzero(mine)], count[mine], lengths[at], start / start.sum(0), gap=gap)
            else:
                pi, found = np.take_along_axis(full[:, at], names, 0), log[at]
            better = found - k * price[at] > best_score[at]
            best[:, at[better]] = 0
            best[names[:, better], at[better]] = pi[:, better]
            best_score[at[better]] = found[better] - k * price[at[better]]
    p[who] = best.T
    return p


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: the remainder of crc32 of the id as text by 4 is 2; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, floor: float = 0.05, most: int | None = None, gap: float = 0.01) -> DataFrame:
    """The languages of every whole text.

    Returns for each row: id_col, lang_pred (the language with the largest proportion; ties go to the
    first by name), score (that proportion), languages (array of lang and share, largest first, of
    shares of at least `floor`), and the columns named in `carry`. A text may mix all languages of the
    model, or `most`; estimates go on until log likelihoods are within `gap` of their maxima.

    Null text, or a text without a letter: "und", score 0, no languages; so are all texts under a model
    without languages. A text with letters but fewer bytes than a gram takes the first language with
    score 0. Null, tied or repeated ids: each row by itself. An empty table gives an empty one.
    Columns that are not carried are ignored, whatever their names.
    """
    carry = carry or []
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType([source.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(share)), *[source.schema[f"c{i}"] for i in range(len(carry))]])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_languages * CLASSES numbers at most
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        model = sent.value
        for whole in batches:
            for batch in slices(whole, "text", 64 << 10):
                p = mixtures(model, *grams(batch.column("text")), batch.num_rows, most, gap)
                known = _lettered(batch.column("text")) & bool(model.languages)
                top = p.argmax(1) if model.languages else np.zeros(len(p), np.int64)
                pred = [model.languages[j] if ok else UNDETERMINED for j, ok in zip(top, known)]
                score = [float(min(1.0, p[i, j])) if ok else 0.0 for i, (j, ok) in enumerate(zip(top, known))]
                shares = [[{"lang": model.languages[j], "share": float(p[i, j])} for j in np.argsort(-p[i], kind="stable") if p[i, j] >= floor] if ok else [] for i, ok in enumerate(known)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred), pa.array(score), pa.array(shares, kind), *[batch.column(f"c{i}") for i in range(len(carry))]], names=schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "languages", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
