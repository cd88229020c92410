"""Exact substring dedup by super-k-mers.

A window is `size` consecutive words. Its minimiser is the smallest hash of the short word runs in
it. Consecutive windows of a text with one minimiser travel as one packed string of words to
the minimiser's bucket, where sorting finds windows that occur in several documents. Sorting is by
fingerprints, but windows count as equal only when their words are. Three steps keep this small and even:
minimisers that occur in one document only are answered first and their windows stay at home; of
windows that a group holds in several documents, only those of its smallest id travel, so a passage
that very many documents share reaches its bucket once per group; and the first answer tells which
minimisers have very many windows, as a short passage in ever other surroundings has: those windows
are dealt further by their fingerprints, which are the same wherever their words are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Routes, from_ipc, group_rows, pack, pieces, squeeze, to_ipc, total_bytes, unsqueeze
from .text import Words, give_back, inside_texts, mix, utf8, window_hashes

#: Words in the runs among which a window's minimiser is chosen.
RUN = 5
#: Different windows of one minimiser that go to one bucket, about.
HOT = 4096


def _minimisers(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the minimiser of each window of `size` words (leftmost smallest)."""
    runs = mix(window_hashes(h, RUN, 3), 9)
    span = size - RUN + 1
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, width = runs.copy(), 1
    at = np.arange(len(runs))
    while width < span:
        step = min(width, span - width)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(a)])
        low = np.where(right, b, a)
        width += step
    return low[:n], at[:n]


class _Windows:
    """The windows of a group of texts: word hashes, window fingerprints, document and minimiser of each."""

    def __init__(self, table: pa.Table, text: str, size: int):
        self.words = Words(*utf8(table.column(text)))
        self.hash = self.words.hashes()
        self.valid = np.flatnonzero(inside_texts(self.words.first, size))
        self.doc = self.words.text_of_word()[self.valid]
        low, at = _minimisers(self.hash, size)
        self.low, self.at = mix(low[self.valid], 13), at[self.valid]  # a minimum is small; mixed again, it is even over the buckets


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """Dense ranks of the ids, so that ids of any type compare as integers; null is -1 and matches nothing."""
    r = pc.rank(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    null = np.asarray(pc.is_null(ids))
    return np.where(null, -1, r)


def _own_key(h1, h2) -> np.ndarray:
    """Sorts by both halves of a window's fingerprint; returns order and a group number along it."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1


def _equal_windows(words: Words, h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """A group number for each window of `size` words (they begin at words `at`, ascending), equal where the words are; and how many.

    Fingerprints only propose groups: each window is compared with the first of its group, neighbours
    that have neighbours as firsts in one go, and a group that holds other words too is dealt by words.
    """
    if not len(at):
        return np.zeros(0, np.int64), 0
    order, sorted_group = _own_key(window_hashes(h, size, 21)[at], window_hashes(h, size, 22)[at])
    first = order[np.flatnonzero(np.diff(sorted_group, prepend=-1))]
    group = np.empty(len(order), np.int64)
    group[order] = sorted_group
    n = len(first)
    again = np.flatnonzero(first[group] != np.arange(len(group)))
    p, q = at[again], at[first[group[again]]]
    new = np.ones(len(again), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(q) != 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(again)))
    raw, wrong = words.data.tobytes(), []
    spans = [x.tolist() for x in (words.starts[p[begin]], words.ends[p[begin] + length + size - 2], words.starts[q[begin]], words.ends[q[begin] + length + size - 2])]
    for i, (a, b, c, d) in enumerate(zip(*spans)):
        if raw[a:b] != raw[c:d] and raw[a:b].split() != raw[c:d].split():
            wrong.append(again[begin[i] : begin[i] + length[i]])
    if wrong:
        dealt: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(group, group[np.concatenate(wrong)])):
            key = b" ".join(raw[words.starts[at[i]] : words.ends[at[i] + size - 1]].split())
            group[i] = dealt.setdefault((int(group[i]), key), n + len(dealt))
        n += len(dealt)
    return group, n


def _spell(words: Words, which: np.ndarray) -> np.ndarray:
    """The bytes of the words `which`, a space after each."""
    length = words.ends[which] - words.starts[which] + 1
    begin = np.cumsum(length) - length
    out = words.data[np.minimum(np.repeat(words.starts[which] - begin, length) + np.arange(int(length.sum())), len(words.data) - 1)]
    out[begin + length - 1] = 32
    return out


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, carry: list[str] | None = None, group_bytes: int = 4 << 20) -> DataFrame:
    """Marks the words covered by a window whose words also start in a document with a smaller id.

    Windows are judged on the input, words compared unchanged. Returns for each row: id_col, n_words,
    n_removed, kept_words (the kept words joined by one space), kept_text (the text without the
    removed spans; an untouched text is returned as it is), and the columns named in `carry`.

    Null or empty text: no words, kept_words is empty, kept_text is the text itself. A null id has no
    order: its windows neither remove nor are removed. Rows that repeat an id are one document here:
    they never remove each other's words. Texts with fewer than `size` words stay whole. An empty
    table gives an empty one. Columns of df that are not carried are ignored, whatever their names.
    """
    carry = carry or []
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    n_bytes = total_bytes(source, "__text")
    groups = pieces(n_bytes, group_bytes)
    bits = max(3, (groups - 1).bit_length() - 1)  # even buckets get something from most groups, so there are fewer
    shift = np.uint64(64 - bits)
    routes = Routes(groups, 1 << bits)
    packed = pack(source, ["__id", "__text"], groups)
    order_by = ["__id", "__text"]
    kind = source.schema["__id"].dataType

    def rows_of(table):
        rows = group_rows(table, order_by)
        return rows, _Windows(rows, "__text", size), _ranks(rows.column("__id"))

    def minimiser_docs(w, rank):
        """The distinct minimisers of the group, windows' places among them, 1 (or 2 where several documents have it) and about how many different windows it has."""
        uniq, inverse = np.unique(w.low, return_inverse=True)
        lo, hi = np.full(len(uniq), 2**62), np.full(len(uniq), -(2**62))
        np.minimum.at(lo, inverse, rank[w.doc])
        np.maximum.at(hi, inverse, rank[w.doc])
        begin, length = super_kmers(w, np.arange(len(w.valid)), w.low)
        order, kind = _own_key(inverse[begin].astype(np.uint64), window_hashes(w.hash, size, 21)[w.valid[begin]] if len(begin) else np.zeros(0, np.uint64))
        once = order[np.flatnonzero(np.diff(kind, prepend=-1))]  # of runs of windows that begin alike, one
        windows = np.bincount(inverse[begin[once]], weights=length[once], minlength=len(uniq))
        return uniq, inverse, np.where(lo < hi, 2, 1).astype(np.uint8), np.minimum(windows, 65535).astype("<u2")

    def ask_minimisers(table):
        _, w, rank = rows_of(table)
        uniq, _, times, windows = minimiser_docs(w, rank)
        bucket = (uniq >> shift).astype(np.int64)
        low = ((uniq << np.uint64(bits)) >> np.uint64(24)).astype("<u8")
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, b in zip(cut, [*cut[1:], len(bucket)]):
            seen = squeeze(times[a:b])
            out.append((int(bucket[a]), int(b - a).to_bytes(8, "little") + len(seen).to_bytes(8, "little") + low[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + seen + squeeze(windows[a:b])))
        return out

    def count_minimisers(payloads):
        lows, times, windows, sizes = [], [], [], []
        for p in payloads:
            n, seen = int.from_bytes(p[:8], "little"), int.from_bytes(p[8:16], "little")
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(p, np.uint8, 5 * n, 16).reshape(n, 5)
            lows.append(wide.view("<u8").ravel())
            at = 16 + 5 * n
            times.append(unsqueeze(p[at : at + seen], np.uint8))
            windows.append(unsqueeze(p[at + seen :], "<u2"))
            sizes.append(n)
        _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        shared = np.bincount(inverse, weights=np.concatenate(times))[inverse] > 1
        parts = np.where(shared, -(-np.bincount(inverse, weights=np.concatenate(windows)) // HOT)[inverse], 0).astype(np.int64)
        return [flags_and_parts(x) for x in np.split(parts, np.cumsum(sizes)[:-1])]

    def flags_and_parts(parts):
        """Which minimisers are shared, as bits, and into how many parts those with very many windows go."""
        bits = squeeze(np.packbits(parts > 0))
        hot = np.flatnonzero(parts > 1)
        return len(bits).to_bytes(8, "little") + bits + squeeze(np.stack([hot, parts[hot]]).astype("<i8"))

    def parts_of_answer(p, n):
        bits = int.from_bytes(p[:8], "little")
        parts = np.unpackbits(unsqueeze(p[8 : 8 + bits], np.uint8), count=n).astype(np.int64)
        hot, into = unsqueeze(p[8 + bits :], "<i8").reshape(2, -1)
        parts[hot] = into
        return parts

    def at_home(w, rank):
        """Windows that a smaller id of the group has too (marked), and those of the smallest id there."""
        group, n = _equal_windows(w.words, w.hash, w.valid, size)
        r = rank[w.doc]
        low = np.full(n, 2**62)
        np.minimum.at(low, group, np.where(r < 0, 2**62, r))
        first = low[group]
        return (r > first) & (r >= 0), (r == first) & (r >= 0)

    def travelling(w, rank, parts):
        marked, first = at_home(w, rank)
        return marked, np.flatnonzero(first & (parts > 0))

    def super_kmers(w, go, goal):
        """Runs of consecutive windows `go` of one text, minimiser and goal: (first index into go, length)."""
        new = np.ones(len(go), bool)
        new[1:] = (np.diff(w.valid[go]) != 1) | (w.doc[go][1:] != w.doc[go][:-1]) | (w.at[go][1:] != w.at[go][:-1]) | (goal[1:] != goal[:-1])
        begin = np.flatnonzero(new)
        return begin, np.diff([*begin, len(go)])

    def parts_of(w, rank, answers):
        """For each window, into how many parts its minimiser's windows go: none if no other document has it."""
        uniq, inverse, _, _ = minimiser_docs(w, rank)
        bucket = (uniq >> shift).astype(np.int64)
        parts = np.zeros(len(uniq), np.int64)
        for b, p in answers.items():
            a, z = np.searchsorted(bucket, [b, b + 1])
            parts[a:z] = parts_of_answer(p, z - a)
        return parts[inverse]

    def routed(w, go, parts):
        """Super-k-mers in the order in which they are sent: (bucket, first index into go, windows)."""
        goal = (w.low[go] >> shift).astype(np.int64)
        hot = np.flatnonzero(parts[go] > 1)
        if len(hot):
            mark = mix(window_hashes(w.hash, size, 21)[w.valid[go[hot]]], 17)
            goal[hot] = (goal[hot] + (mark % parts[go[hot]].astype(np.uint64)).astype(np.int64)) % (1 << bits)
        begin, length = super_kmers(w, go, goal)
        bucket = goal[begin]
        order = np.argsort(bucket, kind="stable")
        return bucket[order], begin[order], length[order]

    def ranges(begin, length):
        """begin[i], ..., begin[i] + length[i] - 1 for each i."""
        total = int(length.sum())
        return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)

    def send_windows(table, answers):
        rows, w, rank = rows_of(table)
        parts = parts_of(w, rank, answers)
        _, go = travelling(w, rank, parts)
        bucket, begin, length = routed(w, go, parts)
        ids = rows.column("__id").combine_chunks()
        found = []
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, z in zip(cut, [*cut[1:], len(bucket)]):
            b, n = begin[a:z], length[a:z]
            spelt = _spell(w.words, ranges(w.valid[go[b]], n + size - 1))
            head = pa.table({"id": ids.take(pa.array(w.doc[go[b]])), "n": pa.array(n.astype(np.int32))})
            head = to_ipc(head)
            found.append((int(bucket[a]), len(head).to_bytes(8, "little") + head + squeeze(spelt)))
        give_back()
        return routes.messages(table.column("grp")[0].as_py(), found)

    def judge_windows(payloads):
        heads, texts, sizes = [], [], []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            heads.append(from_ipc([p[8 : 8 + n]]))
            texts.append(unsqueeze(p[8 + n :], np.uint8))
            sizes.append(pc.sum(heads[-1].column("n")).as_py())
        head = pa.concat_tables(heads)
        count = head.column("n").to_numpy().astype(np.int64)
        data = np.concatenate(texts)
        words = Words(data, np.array([0, len(data)]))
        at = ranges(np.cumsum(count + size - 1) - (count + size - 1), count)
        group, n = _equal_windows(words, words.hashes(), at, size)
        rank = np.repeat(_ranks(head.column("id")), count)
        low = np.full(n, 2**62)
        np.minimum.at(low, group, rank)
        later = rank > low[group]
        return [squeeze(np.packbits(x)) for x in np.split(later, np.cumsum(sizes)[:-1])]

    def finish(table, first, second):
        rows, w, rank = rows_of(table)
        parts = parts_of(w, rank, first)
        marked, go = travelling(w, rank, parts)
        bucket, begin, length = routed(w, go, parts)
        sent = np.cumsum(length)
        later = np.zeros(int(sent[-1]) if len(sent) else 0, bool)
        for b, p in second.items():
            a, z = np.searchsorted(bucket, [b, b + 1])
            lo, hi = (sent[a - 1] if a else 0), sent[z - 1]
            later[lo:hi] = np.unpackbits(unsqueeze(p, np.uint8), count=hi - lo).astype(bool)
        marked[go[ranges(begin, length)[later]]] = True
        n_words = w.words.counts
        cover = np.zeros(int(w.words.first[-1]) + 1, np.int64)
        np.add.at(cover, w.valid[marked], 1)
        np.add.at(cover, w.valid[marked] + size, -1)
        gone = np.cumsum(cover[:-1]) > 0
        text_of = w.words.text_of_word()
        n_removed = np.bincount(text_of[gone], minlength=len(n_words))
        kept_words, kept_text = kept(w.words, gone, n_removed, rows.column("__text"))
        out = {"__id": rows.column("__id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_words": kept_words, "kept_text": kept_text}
        return pa.table(out | {f"c{i}": rows.column(f"c{i}") for i in range(len(carry))})

    def kept(words, gone, n_removed, texts):
        lines, wholes = [], []
        for i, text in enumerate(texts.to_pylist()):
            a, z = words.first[i], words.first[i + 1]
            raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
            if not n_removed[i]:
                lines.append(b" ".join(raw.split()))
                wholes.append(text)
                continue
            at = words.offsets[i]
            flags = gone[a:z]
            turn = np.flatnonzero(np.diff(flags, prepend=not flags[0]))
            parts, spans = [], []
            for j, k in zip(turn, [*turn[1:], z - a]):
                if not flags[j]:
                    s, e = words.starts[a + j] - at, words.ends[a + k - 1] - at
                    parts.append(b" ".join(raw[s:e].split()))
                    nxt = words.starts[a + k] - at if k < z - a else len(raw)
                    spans.append(raw[(0 if j == 0 else s) : nxt])
            lines.append(b" ".join(parts))
            wholes.append(b"".join(spans).decode())
        return pa.array([x.decode() for x in lines], pa.string()), pa.array(wholes, pa.string())

    shared = routes.answer(routes.ask(packed, ask_minimisers), count_minimisers)
    sent = packed.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(lambda table, replies: send_windows(table, routes.opened(replies)), "grp long, bucket long, payload binary")
    judged = routes.answer(sent, judge_windows)
    both = shared.withColumn("step", F.lit(0)).unionByName(judged.withColumn("step", F.lit(1)))

    def last(table, replies):
        first, second = (routes.opened(replies.filter(pc.equal(replies.column("step"), step))) for step in (0, 1))
        out = finish(table, first, second)
        give_back()
        return out

    schema = T.StructType([T.StructField("__id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType()), T.StructField("kept_text", T.StringType())] + [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])
    done = packed.groupBy("grp").cogroup(both.groupBy("grp")).applyInArrow(last, schema)
    return done.select(F.col("__id").alias(id_col), "n_words", "n_removed", "kept_words", "kept_text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
