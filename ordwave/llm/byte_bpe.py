"""Byte-level BPE over whole texts by a global shuffle of distinct words.

Texts are dealt to packed groups (exchange.py). A group asks for the ids of its distinct pre-tokens,
sorted and compressed; a bucket encodes each distinct pre-token once; the ids come back in the order
of the question and each text is put together by the places of its pre-tokens. Decoding joins ids
with the table of token bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Routes, group_rows, pack, pieces, squeeze, total_bytes, unsqueeze
from .text import slices

#: Ids that are decoded at a time.
STEP = 1 << 16

#: White space as the rank files' pattern means it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", lambda m: rf"\x{{{m[1] or m[2]}}}", _SPACE)  # as Arrow's expressions write it


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class Pretokens:
    """Splits texts at their single spaces, so that each distinct piece is matched once in a group.

    Under the pattern a space between two other characters has to begin a match always, and what
    stands on either side not to change how the other is matched, as is so for the patterns of the
    usual byte-level vocabularies: many pieces are then matched in one run, joined by spaces.
    """

    RUN = 1 << 15

    def __init__(self, pattern: str):
        import regex

        inner = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.find = regex.compile(inner).findall
        self.uneven = rf"\A | [{_WIDE}]|[{_WIDE}]( |\z)"  # white space beside a space, or at an end

    def runs(self, pieces: list[str]):
        """For some pieces at a time: the pieces and the pre-tokens of each ' ' + piece, in a row."""
        for first in range(0, len(pieces), self.RUN):
            some = pieces[first : first + self.RUN]
            yield some, self.find(" " + " ".join(some))


@functools.lru_cache(maxsize=2)
def _pretokens(pattern: str) -> Pretokens:
    return Pretokens(pattern)


class _Cut:
    """Texts cut at their single spaces: `whole` has the texts in which white space meets a space or the text's end, which are not cut.

    Of the others, `first` has the pieces up to the first space, `pieces` the distinct pieces after a
    space, and `which` their numbers in the order of the texts, `times` of each text.
    """

    def __init__(self, texts: pa.ChunkedArray, split: Pretokens):
        texts = pc.fill_null(texts.cast(pa.string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        self.n = len(texts)
        even = ~pc.match_substring_regex(texts, split.uneven).to_numpy(zero_copy_only=False)
        self.whole = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(~even)}
        self.even = np.flatnonzero(even).tolist()
        lists = pc.split_pattern(texts.filter(pa.array(even)), " ")
        flat, length = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.zeros(len(flat), bool)
        begins[np.cumsum(length) - length] = True
        self.first = flat.filter(pa.array(begins)).to_pylist()
        rest = flat.filter(pa.array(~begins)).dictionary_encode()
        self.pieces, self.which, self.times = rest.dictionary.to_pylist(), rest.indices.to_numpy(zero_copy_only=False), length - 1

    def words(self, split: Pretokens) -> set[str]:
        """The distinct pre-tokens of the texts."""
        out: set[str] = set()
        for text in (*self.whole.values(), *self.first):
            out.update(split.find(text))
        for _, found in split.runs(self.pieces):
            out.update(found)
        return out

    def ids(self, split: Pretokens, ids_of: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, put together from those of its pre-tokens."""
        of_piece = _of_pieces(self.pieces, split, ids_of)
        size = np.fromiter(map(len, of_piece), np.int64, len(of_piece)) // 4
        flat, start, length = np.frombuffer(b"".join(of_piece), "<u4"), np.cumsum(size) - size, size[self.which]
        del of_piece
        ends = np.cumsum(length)
        out: list = [b""] * self.n
        last = np.cumsum(self.times)
        for i, head, a, z in zip(self.even, self.first, (last - self.times).tolist(), last.tolist()):
            n = length[a:z]
            at = np.repeat(start[self.which[a:z]] - (ends[a:z] - n), n) + np.arange(ends[a] - n[0], ends[z - 1]) if z > a else np.zeros(0, np.int64)
            out[i] = b"".join([ids_of[w] for w in split.find(head)]) + flat[at].tobytes()
        for i, text in self.whole.items():
            out[i] = b"".join([ids_of[w] for w in split.find(text)])
        return out


def _of_pieces(pieces: list[str], split: Pretokens, ids_of: dict[str, bytes]) -> list[bytes]:
    """The ids of each ' ' + piece: a pre-token that starts with a space begins the next piece."""
    out = []
    for some, found in split.runs(pieces):
        begin = [i for i, w in enumerate(found) if w[0] == " "]
        ids = [ids_of[w] for w in found]
        out += [ids[a] if b == a + 1 else b"".join(ids[a:b]) for _, a, b in zip(some, begin, [*begin[1:], len(found)], strict=True)]
    return out


def _routed(words: set, buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in sorted(x.encode() for x in words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 10 << 20) -> DataFrame:
    """Ids of every whole text by the ranks of a file, each match of `pattern` encoded by itself.

    Returns id_col, n_tokens long and ids, the ids as little-endian unsigned 32-bit integers in
    binary. Null text counts as empty: no ids. Special tokens have no meaning in texts. Null, tied
    or repeated ids: each row is encoded by itself. An empty table gives an empty one. Other
    columns are ignored, whatever their names. The file must be readable at `ranks_path` on executors.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    groups = pieces(total_bytes(source, "__text"), group_bytes)
    buckets = max(8, groups // 2)
    packed = pack(source, ["__id", "__text"], groups)
    order_by = ["__id", "__text"]

    def extract(table):
        split = _pretokens(pattern)
        words = _Cut(group_rows(table, order_by).column("__text"), split).words(split)
        out = []
        for bucket, mine in _routed(words, buckets).items():
            lengths = np.fromiter(map(len, mine), "<u4", len(mine))
            head = squeeze(lengths)
            out.append((bucket, len(head).to_bytes(8, "little") + head + squeeze(np.frombuffer(b"".join(mine), np.uint8))))
        return out

    def reply(payloads):
        ids_of = _encoder(ranks_path, pattern)._encode_single_piece
        known: dict[bytes, bytes] = {}
        out = []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            ends = np.cumsum(unsqueeze(p[8 : 8 + n], "<u4").astype(np.int64)).tolist()
            raw = unsqueeze(p[8 + n :], np.uint8).tobytes()
            found = []
            for a, b in zip([0, *ends], ends):
                w = raw[a:b]
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = array("I", ids_of(w)).tobytes()
                found.append(ids)
            lengths = squeeze(np.fromiter(map(len, found), "<u4", len(found)) // 4)
            out.append(len(lengths).to_bytes(8, "little") + lengths + squeeze(np.frombuffer(b"".join(found), "<u4")))
        return out

    def finish(table, replies):
        rows = group_rows(table, order_by)
        split = _pretokens(pattern)
        cut = _Cut(rows.column("__text"), split)
        routed, ids_of = _routed(cut.words(split), buckets), {}
        while routed:
            bucket, mine = routed.popitem()
            p = replies.pop(bucket)
            n = int.from_bytes(p[:8], "little")
            ends = np.cumsum(4 * unsqueeze(p[8 : 8 + n], "<u4").astype(np.int64)).tolist()
            raw = unsqueeze(p[8 + n :], np.uint8).tobytes()
            for w, a, b in zip(mine, [0, *ends], ends):
                ids_of[w.decode()] = raw[a:b]
        out = cut.ids(split, ids_of)
        del cut, ids_of
        ids = pa.array(out, pa.binary())
        del out
        return pa.table({"__id": rows.column("__id"), "n_tokens": pc.divide(pc.binary_length(ids).cast(pa.int64()), 4), "ids": ids})

    schema = T.StructType([T.StructField("__id", source.schema["__id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    routes = Routes(groups, buckets)
    out = routes.resolve(packed, routes.answer(routes.ask(packed, extract), reply), finish, schema)
    return out.select(F.col("__id").alias(id_col), "n_tokens", "ids")


@functools.lru_cache(maxsize=4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of token bytes by id: where they start, their lengths, and all bytes in a row."""
    ranks = read_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    lengths = np.fromiter(map(len, by_id), np.int64, size)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(by_id), np.uint8)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col, the bytes of the tokens in ids_col (little-endian unsigned 32-bit ids, as encode() gives).

    Null ids give null, empty ids empty bytes; an id that the file does not have fails. The token
    table is as large as the vocabulary. Other columns are kept; one named out_col is replaced.
    """
    rest = [c for c in df.columns if c != out_col]
    place = rest.index(ids_col)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out_col, T.BinaryType())])

    def run(batches):
        start, length, raw = _token_bytes(ranks_path)
        for whole in batches:
            for batch in slices(whole, ids_col):
                found = []
                for x in batch.column(place).to_pylist():
                    if x is None:
                        found.append(None)
                        continue
                    some = []
                    for first in range(0, len(x), 4 * STEP):
                        ids = np.frombuffer(x[first : first + 4 * STEP], "<u4")
                        n = length[ids]
                        at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        some.append(raw[at].tobytes())
                    found.append(b"".join(some))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
