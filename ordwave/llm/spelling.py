"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

The vocabulary is sorted, once as it is and once with its words reversed, and cut into shards. Each
shard becomes a minimal automaton whose perfect-hash numbers are the ranks of its words. A word
matches its first half exactly in the forward automata and its second half in the backward ones, and
is completed with one error; what both directions find counts in the forward one alone.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Frozen
from .text import give_back

#: Words of a shard, about: what one automaton holds.
SHARD = 20_000
LETTERS = "[A-Za-zÀ-ÿ]+"
_LAST = chr(0x10FFFF)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 0, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: how often words of `least_length` code points or more occur, those that do so `least_count` times at least.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With
    `drop_every`, a run loses one code point where crc32 of `id:run` is a multiple of it (of place
    crc32 modulo its length), which plants misspellings that follow from the rows alone.

    Null text: no words. A null id is the empty string in the hash. Repeated rows count each. An empty
    table gives an empty one. Counts are combined before they are shuffled, so a frequent word is no hot key.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(LETTERS), F.lit(0))).alias("w"))
    ascii_only = F.octet_length("w") == F.char_length("w")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.select("id", F.when(ascii_only, F.lower("w")).otherwise(F.translate("w", upper, upper.lower())).alias("w"))
    if drop_every:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")))
        at = F.pmod("h", F.char_length("w").cast("long")).cast("int")
        cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
        rows = rows.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("w")).alias("w"))
    found = rows.where(F.char_length("w") >= least_length).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its rank among them.

    `next[state]` has (target, words before) by letter. States are numbered from the ends of words to
    the root, which is last.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([False], [])]  # per letter of the last word: (final, edges so far)
        before = ""

        def close(upto: int) -> None:
            while len(path) - 1 > upto:
                state = self._state(known, *path.pop())
                path[-1][1].append((before[len(path) - 1], state))

        for word in words:
            same, shorter = 0, min(len(word), len(before))
            while same < shorter and word[same] == before[same]:
                same += 1
            close(same)
            path.extend(([False], []) for _ in word[same:])
            path[-1][0][0] = True
            before = word
        close(0)
        self.root = self._state(known, *path.pop())

    def _state(self, known: dict, final: list, edges: list) -> int:
        key = final[0], tuple(edges)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.next)
            count, out = int(final[0]), {}
            for letter, target in edges:
                out[letter] = target, count
                count += self._count[target]
            self.next.append(out)
            self.final.append(final[0])
            self._count.append(count)
        return state

    def _rest(self, state: int, number: int, rest: str) -> int | None:
        """The number of the word that `rest` completes from here."""
        for letter in rest:
            step = self.next[state].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return number if self.final[state] else None

    def near(self, word: str, exact: int) -> dict[int, str]:
        """{number: word} of the words with exactly one edit at place `exact` or later."""
        state, number, found = self.root, 0, {}
        for place in range(len(word) + 1):
            if place >= exact:
                head, here, after = word[:place], word[place : place + 1], word[place + 1 :]
                if here and (k := self._rest(state, number, after)) is not None:
                    found[k] = head + after
                for letter, (target, skipped) in self.next[state].items():
                    if (k := self._rest(target, number + skipped, here + after)) is not None:
                        found[k] = head + letter + here + after
                    if here and letter != here and (k := self._rest(target, number + skipped, after)) is not None:
                        found[k] = head + letter + after
            step = self.next[state].get(word[place]) if place < len(word) else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _exact(word: str, backward: bool) -> int:
    """Letters that have to match: the first half going forward, the rest going backward."""
    half = len(word) // 2
    return len(word) - half if backward else half


class _Side:
    """One direction: the sorted shards of its words, and what of the vocabulary lies near in it."""

    def __init__(self, vocabulary: DataFrame, n_words: int, backward: bool):
        self.backward = backward
        spelled = F.reverse("word") if backward else F.col("word")
        dealt = vocabulary.select(spelled.alias("word"), "n").repartitionByRange(max(1, -(-n_words // SHARD)), "word").withColumn("shard", F.spark_partition_id().cast("long"))
        self.words = Frozen(dealt).df  # written, so that a word's shard stays what it is
        ends = self.words.groupBy("shard").agg(F.min("word").alias("first"), F.max("word").alias("last")).orderBy("first").collect()  # a row per shard
        self.shards, self.first, self.last = [r["shard"] for r in ends], [r["first"] for r in ends], [r["last"] for r in ends]

    def automata(self) -> DataFrame:
        """shard, automaton: of each shard, its automaton and its words' counts by number, as bytes."""

        def build(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
            made = pickle.dumps((Automaton([w for w, _ in rows]), np.array([n for _, n in rows], np.int64)))
            del rows
            give_back()
            return pa.table({"shard": table.column("shard")[:1], "automaton": pa.array([pa.compress(made, codec="zstd", asbytes=True)], pa.binary()), "size": pa.array([len(made)], pa.int64())})

        return self.words.groupBy("shard").applyInArrow(build, "shard long, automaton binary, size long")

    def asked(self) -> DataFrame:
        """Each word with each shard that may hold words that begin as it does: shard, source (its own), word."""
        shards, first, last, backward = np.array(self.shards, np.int64), np.array(self.first, object), np.array(self.last, object), self.backward

        def run(batches):
            for batch in batches:
                words = batch.column("word").to_pylist()
                heads = np.array([w[: _exact(w, backward)] for w in words], object)
                low = np.searchsorted(last, heads, "left")
                high = np.searchsorted(first, np.array([h + _LAST for h in heads], object), "right")
                times = np.maximum(high - low, 0)
                at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows = pa.array(np.repeat(np.arange(len(words)), times))
                yield pa.RecordBatch.from_arrays([pa.array(shards[at]), batch.column("shard").take(rows), batch.column("word").take(rows)], ["shard", "source", "word"])
            give_back()

        return self.words.select("word", "shard").mapInArrow(run, "shard long, source long, word string")

    def found(self) -> DataFrame:
        """word, n_near, near_n, near: for words with near ones that this direction counts, their number, and the most frequent.

        A group holds an automaton and those words of one source shard that ask it, so it is as small
        for a common beginning as for any other.
        """
        asked, backward = self.asked(), self.backward
        groups = asked.select(F.col("shard").alias("to"), F.col("source").alias("by")).distinct()
        sent = groups.join(self.automata().withColumnRenamed("shard", "to"), "to")

        def match(words: pa.Table, automata: pa.Table) -> pa.Table:
            payload = pa.decompress(automata.column("automaton")[0].as_py(), decompressed_size=automata.column("size")[0].as_py(), codec="zstd", asbytes=True)
            automaton, counts = pickle.loads(payload)
            del payload
            out = []
            for word in words.column("word").to_pylist():
                near = automaton.near(word, _exact(word, backward))
                if backward:
                    word, half = word[::-1], len(word) // 2
                    near = {k: v[::-1] for k, v in near.items()}
                    near = {k: v for k, v in near.items() if v[:half] != word[:half]}  # else found going forward
                if near:
                    n, best = min((-int(counts[k]), v) for k, v in near.items())
                    out.append((word, len(near), -n, best))
            del automaton, counts
            give_back()
            return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

        return asked.groupBy("shard", "source").cogroup(sent.groupBy("to", "by")).applyInArrow(match, "word string, n_near long, near_n long, near string")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: forms (word, root) followed to the last, twice as far in each turn. Forms have larger counts, so no chain is a circle."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = Frozen(links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = step.df.select("word", "root")
        if not step.df.agg(F.max("moved")).first()[0]:
            return links


def variants(counts: DataFrame, ratio: float = 2.0) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their counts (word, n).

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form
    is its near word of largest n (ties: the smallest word), if that is at least `ratio` times its own
    n, else null; its root is the last form of forms, or itself.

    Null words are left out; words are expected once each. An empty table gives an empty one; words
    without near words have n_near 0. Memory: an automaton and the words of one source shard in a task.
    Words go to every shard that holds words with the same first (or last) half: mostly one or two,
    more where many shards share a half.
    """
    vocabulary = Frozen(counts.where("word is not null").select("word", F.col("n").cast("long").alias("n"))).df
    n_words = vocabulary.count()
    found = _Side(vocabulary, n_words, False).found().unionByName(_Side(vocabulary, n_words, True).found())
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    counts_of = F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less"))
    near = Frozen(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), counts_of.alias("form_n"), F.when(counts_of.isNotNull(), F.col("best.near")).alias("form"))).df
    roots = _roots(near.where("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
