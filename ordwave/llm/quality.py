"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule reads statistics of a whole text and votes good, bad, or abstains. Documents with the same
votes are counted together, so expectation maximisation runs over at most 3 ** (number of rules) vote
patterns, whatever the number of documents. It estimates the share of good documents and how often
each rule is right about either class; a document is kept if its posterior probability of being good
reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Frozen
from .text import Words, inside_texts, slices, span_hashes, utf8, window_hashes

#: Words of a window in which fresh words are counted, so that a text's length does not decide how many there are.
WINDOW = 200
#: Statistics of a text, all long; fresh words are those that their window has not had before.
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_fresh_words", "n_upper", "n_letters", "n_marks"]

_SYMBOL, _UPPER, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[list(b".,;:!?")] = True


def _repeats(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs at least twice for its owner, is not the first such) for each key."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.empty(len(o), bool), np.empty(len(o), bool)
    out[order], later[order] = twice, same
    return out, later


def text_statistics(column) -> dict[str, np.ndarray]:
    """STATISTICS of each text of an Arrow column; a null text has zeros."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    words = Words(data, offsets)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    texts, h = words.text_of_word(), words.hashes()
    start = words.inside & ((data & 0xC0) != 0x80)
    ok = np.flatnonzero(inside_texts(words.first, 3))
    twice, _ = _repeats(texts[ok], window_hashes(h, 3)[ok]) if len(ok) else (np.zeros(0, bool), None)
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[ok[twice] + j] = True
    place = np.arange(len(h)) - words.first[texts]
    window = np.cumsum((place % WINDOW == 0) | (place == 0))
    _, again = _repeats(window, h)
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_start, line_text))
    line_start, line_text = line_start[order], line_text[order]
    line_end = np.empty(len(line_start), np.int64)
    line_end[:-1] = np.where(line_text[1:] == line_text[:-1], line_start[1:] - 1, offsets[line_text[:-1] + 1])
    if n:
        line_end[-1] = offsets[n]
    lived = np.searchsorted(words.starts, line_end) > np.searchsorted(words.starts, line_start)
    line_start, line_end, line_text = line_start[lived], line_end[lived], line_text[lived]
    _, dup = _repeats(line_text, span_hashes(data, line_start, line_end))
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    lettered = letters[words.ends] > letters[words.starts]
    count = lambda where: np.bincount(where, minlength=n)
    return {
        "n_words": words.counts, "word_chars": per_text(start), "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": count(line_text[dup]), "n_repeat_words": count(texts[covered]), "n_lines": count(line_text),
        "n_letter_words": count(texts[lettered]), "n_fresh_words": count(texts[~again]), "n_upper": per_text(_UPPER[data]), "n_letters": per_text(_LETTER[data]), "n_marks": per_text(_MARK[data]),
    }


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _all(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def _any(*conditions: Column) -> Column:
    return reduce(or_, conditions)


_symbols, _dense = partial(_share, "n_symbols", "n_words"), partial(_share, "n_symbols", "word_chars")
_repeated, _twice, _fresh = partial(_share, "n_repeat_words", "n_words"), partial(_share, "n_dup_lines", "n_lines"), partial(_share, "n_fresh_words", "n_words")
_lettered, _size, _upper, _marked = partial(_share, "n_letter_words", "n_words"), partial(_share, "word_chars", "n_words"), partial(_share, "n_upper", "n_letters"), partial(_share, "n_marks", "n_words")

#: The production rules. Each votes both ways and abstains in between; bounds are wide enough that good texts, too, get a bad vote now and then.
RULES = [
    Rule("length", lambda: F.col("n_words") < 60, lambda: F.col("n_words") >= 100),
    Rule("symbols", lambda: _symbols() > 0.1, lambda: _symbols() <= 0.02),
    Rule("density", lambda: _dense() > 0.05, lambda: _dense() <= 0.005),
    Rule("repeats", lambda: _repeated() > 0.15, lambda: _repeated() < 0.05),
    Rule("lines", lambda: (F.col("n_lines") > 4) & (_twice() > 0.15), lambda: (F.col("n_lines") > 4) & (_twice() < 0.05)),
    Rule("letters", lambda: _lettered() < 0.9, lambda: _lettered() > 0.97),
    Rule("word_length", lambda: ~_size().between(3.5, 6.5), lambda: _size().between(4, 6)),
    Rule("case", lambda: _upper() > 0.1, lambda: _upper() < 0.05),
    Rule("marks", lambda: ~_marked().between(0.05, 0.3), lambda: _marked().between(0.08, 0.22)),
    Rule("variety", lambda: _fresh() < 0.5, lambda: _fresh() > 0.65),
    Rule("prose", lambda: _any(_symbols() > 0.3, _lettered() < 0.8, _upper() > 0.3, _marked() > 0.6), lambda: _all(_symbols() <= 0.02, _lettered() > 0.95, _marked().between(0.05, 0.3), _size().between(3.5, 8), _upper() < 0.1)),
]


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents, and how often each rule votes bad, good or abstains (last axis) on good and bad ones (first)."""

    prior: float
    rates: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds of good: to begin with, and what each rule's bad vote, good vote and abstention add."""
        return float(np.log(self.prior) - np.log1p(-self.prior)), np.log(self.rates[0] / self.rates[1])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes (0 bad, 1 good, -1 abstain)."""
        start, add = self.weights()
        log = start + add[np.arange(votes.shape[1]), np.where(votes < 0, 2, votes)].sum(1)
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))


#: What a rule is expected to do before any votes are seen: bad, good, abstain on good documents, then on bad ones.
EXPECTED = np.array([[0.02, 0.58, 0.4], [0.45, 0.15, 0.4]])


def fit_votes(votes: np.ndarray, weight: np.ndarray, rounds: int = 500, strength: float = 0.01) -> VoteModel:
    """Expectation maximisation over vote patterns with counts.

    It starts by doubting documents with two bad votes or more, so that 'good' keeps its meaning. The
    rates of a rule have a Dirichlet prior around EXPECTED, worth `strength` of the documents: false
    alarms are estimated like all else, and a corpus without bad documents is not parted at its
    rarest votes. No documents: all rules count as expected.
    """
    n = float(weight.sum()) or 1.0
    cast = np.stack([votes == 0, votes == 1, votes < 0], axis=2).astype(float)
    p = np.where(cast[:, :, 0].sum(1) >= 2, 0.1, 0.9)
    usual = strength * n * EXPECTED
    for _ in range(rounds):
        mass = np.stack([weight * p, weight * (1 - p)])
        rates = np.einsum("ck,krv->crv", mass, cast) + usual[:, None, :]
        model = VoteModel(float(np.clip((mass[0].sum() + 0.5) / (n + 1), 0.01, 0.99)), rates / rates.sum(2, keepdims=True))
        after = model.posterior(votes)
        if len(p) == 0 or np.abs(after - p).max() < 1e-9:
            break
        p = after
    return model


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_id: bool = True, text_at: int | None = None) -> DataFrame:
    """id, the STATISTICS of each row's text, and the carried columns as c0, c1, ...

    Where the text itself is carried, `text_at` names its place among them and it is sent to Python once.
    """
    carry = carry or []
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    name = "text" if text_at is None else f"c{text_at}"
    source = docs.select(*[F.col(f"`{id_col}`").alias("id")] * keep_id, *[text] * (text_at is None), *columns)
    first = ["id"] * keep_id
    schema = T.StructType([*[source.schema[c] for c in first], *[T.StructField(s, T.LongType()) for s in STATISTICS], *[source.schema[f"c{i}"] for i in range(len(carry))]])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, name):
                found = text_statistics(batch.column(name))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in first], *[pa.array(found[s].astype(np.int64)) for s in STATISTICS], *[batch.column(f"c{i}") for i in range(len(carry))]], names=schema.names)

    return source.mapInArrow(run, schema)


def _votes(rules: list[Rule]) -> Column:
    return F.array(*[F.when(r.bad(), 0).when(r.good(), 1).otherwise(-1) for r in rules])


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fitted(counted: DataFrame, rules: list[Rule]) -> VoteModel:
    patterns = counted.where(~_failed()).groupBy(_votes(rules).alias("__votes")).count().collect()  # at most 3 ** len(rules) rows
    votes = np.array([r["__votes"] for r in patterns], np.int64).reshape(-1, len(rules))
    return fit_votes(votes, np.array([r["count"] for r in patterns], np.float64))


def _judged(counted: DataFrame, rules: list[Rule], model: VoteModel, threshold: float) -> DataFrame:
    """counted with base_failed, p_good and kept."""
    start, add = model.weights()
    log = F.lit(start)
    for j, r in enumerate(rules):
        log = log + F.when(r.bad(), float(add[j, 0])).when(r.good(), float(add[j, 1])).otherwise(float(add[j, 2]))
    out = counted.withColumn("p_good", 1 / (1 + F.exp(-log))).withColumn("base_failed", _failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rules: list[Rule] | None = None) -> DataFrame:
    """The posterior probability that each document is good, by rules whose accuracy is estimated from all of them.

    Returns for each row: id_col, the STATISTICS, base_failed (fewer than 50 words, or more than half
    of its words in repeated 3-word windows), p_good, kept (not base_failed, and p_good >= threshold).

    Null or empty text: all statistics 0, base_failed. Null, tied or repeated ids: each row is judged
    by itself. Votes that all abstain: the estimated share of good documents decides. An empty table
    gives an empty one. Other columns are ignored, whatever their names.
    """
    rules = rules or RULES
    counted = Frozen(with_statistics(docs, id_col, text_col)).df
    out = _judged(counted, rules, _fitted(counted, rules), threshold)
    return out.select(F.col("id").alias(id_col), *STATISTICS, "base_failed", "p_good", "kept")


def kept_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that quality() keeps, with all columns, whatever their names.

    Texts are read twice, first to count votes and then to judge, so that nothing but the result is
    written. The cases of quality() hold: null and empty texts go, each row is judged by itself.
    """
    rules = rules or RULES
    model = _fitted(with_statistics(docs, text_col, text_col, keep_id=False), rules)
    text = docs.columns.index(text_col)
    counted = with_statistics(docs, text_col, text_col, docs.columns, keep_id=False, text_at=text)
    return _judged(counted, rules, model, threshold).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
