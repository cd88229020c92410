"""Ids of whole texts under a tokenizer that drops white space: words are encoded once and remembered.

Such a tokenizer treats what stands between ASCII white space independently, so a text's ids are
those of its words in a row. Arrow numbers the distinct words of some texts; each Python worker keeps
the ids of words that it has seen in sorted arrays, some 40 bytes a word, up to a bound. Texts that
hold an added token of the tokenizer are encoded as a whole.
"""

from __future__ import annotations

import functools
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import span_hashes, utf8


def _taken(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans of `flat` with these starts and lengths, one after another."""
    ends = np.cumsum(length)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)]


@dataclass(eq=False)
class _Known:
    """Words by ascending hash of their bytes: `spelled` has the bytes, `ids` the ids, of the spans at start and length."""

    hashes: np.ndarray
    spelled: np.ndarray
    word: np.ndarray
    word_size: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, hashes, spelled, word_size, ids, size) -> _Known:
        """From words in any order, whose bytes and ids follow one another."""
        order = np.argsort(hashes, kind="stable")
        placed = lambda a: a[order].astype(np.int32)
        return cls(hashes[order], spelled, placed(np.cumsum(word_size) - word_size), placed(word_size), ids, placed(np.cumsum(size) - size), placed(size))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray, spelled: np.ndarray, word: np.ndarray, word_size: np.ndarray) -> np.ndarray:
        """The place here of each word, or -1. Equal hashes propose, equal bytes decide."""
        if not len(self):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        same = np.flatnonzero((self.hashes[place] == hashes) & (self.word_size[place] == word_size))
        mine, theirs = _taken(self.spelled, self.word[place[same]], word_size[same]), _taken(spelled, word[same], word_size[same])
        differ = np.add.reduceat(mine != theirs, np.cumsum(word_size[same]) - word_size[same]) if len(same) else np.zeros(0)
        out = np.full(len(hashes), -1)
        out[same[differ == 0]] = place[same[differ == 0]]
        return out

    def joined(self, other: _Known) -> _Known:
        order = np.argsort(hashes := np.concatenate([self.hashes, other.hashes]), kind="stable")
        both = lambda a, b, shift=0: np.concatenate([a, b + np.int32(shift)])[order]
        return _Known(
            hashes[order], np.concatenate([self.spelled, other.spelled]), both(self.word, other.word, len(self.spelled)), both(self.word_size, other.word_size),
            np.concatenate([self.ids, other.ids]), both(self.at, other.at, len(self.ids)), both(self.size, other.size),
        )


class WordIds:
    """Ids of texts, with a memory of words.

    When there are BOUND words in the newer part of the memory, it becomes the older part, which goes;
    a word of the older part that occurs again is kept. So words that keep occurring stay, in bounded memory.
    """

    BOUND = 1_000_000
    LOT = 200
    #: Bytes of the longest words that are remembered.
    LONGEST = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(added.items()) if t.special)
        self.older: list[_Known] = []
        self.newer: list[_Known] = []

    def __len__(self) -> int:
        return sum(map(len, self.newer)) + sum(map(len, self.older))

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Words go in lots, parted by a special token; those with its first character go alone."""
        size, out = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)] * len(words)
        rest = [i for i, w in enumerate(words) if self.mark[0] not in w]
        lots = [rest[i : i + self.LOT] for i in range(0, len(rest), self.LOT)]
        made = (e for i in range(0, len(lots), 16) for e in self.tokenizer.encode_batch_fast([self.mark.join([words[j] for j in lot]) for lot in lots[i : i + 16]], add_special_tokens=False))  # few at a time: an encoding is far larger than its ids
        for lot, e in zip(lots, made):
            found = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(found == self.mark_id)
            if len(marks) != len(lot) - 1:
                raise ValueError("a word holds the token that parts words")
            for i, part in zip(lot, np.split(found, marks)):
                out[i] = part
            for i in lot[1:]:
                out[i] = out[i][1:]
        for i in set(range(len(words))).difference(rest):
            out[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
        size[:] = [len(x) for x in out]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), size

    def _keep(self, known: _Known) -> None:
        if sum(map(len, self.newer)) + len(known) > self.BOUND:
            self.older, self.newer = self.newer, []
        while self.newer and len(self.newer[-1]) < 2 * len(known):
            known = self.newer.pop().joined(known)
        self.newer.append(known)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of distinct words."""
        spelled, ends = utf8(words)
        word, word_size = ends[:-1], np.diff(ends)
        hashes = span_hashes(spelled, word, ends[1:])
        todo, size = np.arange(len(words)), np.zeros(len(words), np.int64)
        got, held = [], []  # (which words, ids one after another), and what goes to the newer part
        for part in [*self.newer[::-1], *self.older]:
            place = part.find(hashes[todo], spelled, word[todo], word_size[todo])
            mine, place = todo[place >= 0], place[place >= 0]
            size[mine] = part.size[place]
            got.append((mine, _taken(part.ids, part.at[place], part.size[place])))
            if part not in self.newer:
                held.append(got[-1])
            todo = todo[~np.isin(todo, mine)]
        if len(todo):
            ids, size[todo] = self.learn(words.take(pa.array(todo)).to_pylist())
            got.append((todo, ids.astype(np.uint32)))
            held.append(got[-1])
        for mine, ids in held:
            start = np.cumsum(size[mine]) - size[mine]
            short = word_size[mine] <= self.LONGEST
            mine, start = mine[short], start[short]
            if len(mine):
                self._keep(_Known.of(hashes[mine], _taken(spelled, word[mine], word_size[mine]), word_size[mine], _taken(ids, start, size[mine]), size[mine]))
        out, at = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for mine, ids in got:
            n = size[mine]
            out[np.arange(len(ids)) + np.repeat(at[mine] - (np.cumsum(n) - n), n)] = ids
        return out, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text, as the tokenizer gives them without special tokens of its own; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        there = pc.greater(pc.binary_length(words), 0)
        words, owner = words.filter(there), owner[there.to_numpy(zero_copy_only=False)]
        distinct = words.dictionary_encode()
        ids, size = self._ids_of(distinct.dictionary)
        number = distinct.indices.to_numpy(zero_copy_only=False)
        flat = _taken(ids, (np.cumsum(size) - size)[number], size[number]).astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, weights=size[number], minlength=len(texts)).astype(np.int64)) * 4
        out = [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
