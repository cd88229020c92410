"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are its distinct word shingles. If two sets reach the threshold, then under any
total order of tokens their prefixes of length n - ceil(t n) + 1 share a token. Tokens of one
document come first in every order; the shared ones follow, rarest first in the first order and by
independent hashes in the others. Candidates share a token of the first order's prefixes, must also
share a prefix token under each other order, and only then are whole sets compared.

A token's place in the first order bounds what two sets can share from there on: where it stands
beyond (1 - t) / (1 + t) of both sets, they cannot reach t with it as their first common token. So
of a token's nodes only pairs with an early one are candidates, and tokens without early nodes are
none: texts of one template that differ by enough words of their own are never paired.

How often a token occurs is asked once per packed group (exchange.py), so nothing grows with copies
of one text. Equal sets become one node. Nodes that share a prefix token are a group; groups with the
same nodes count once. A group is first linked to a pivot, in a fixed number of turns with new
pivots; groups whose nodes are connected then are done. In the others, the nodes outside the group's
main component are compared with the nodes of that component, once for each component however many
tokens they share, and with each other. So near copies give few pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import Components, connected_components
from .exchange import Frozen, Routes, group_rows, pack, parts_of, pieces, squeeze, total_bytes, unsqueeze
from .text import Words, give_back, mix, shingles, utf8

#: Orders after the first; each adds a filter that candidates must pass.
MORE_ORDERS = 2
#: Turns in which groups are linked to a pivot before what is still apart is compared.
STAR_TURNS = 2
#: Nodes on a side of a block of comparisons, and rows of several blocks that a task takes at a time.
BLOCK, ROWS = 256, 1024


def _sets(text, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token) sorted and distinct, and the number of tokens of each text."""
    data, offsets = utf8(text)
    words = Words(data, offsets)
    rows, keys = shingles(words, words.hashes(lower=True), size)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        rows, keys = rows[new], keys[new]
    return rows, keys, np.bincount(rows, minlength=len(offsets) - 1)


def _prints(keys: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit fingerprint of each set; None for an empty set."""
    raw, ends = memoryview(keys.view(np.uint8)), np.cumsum(counts) * 8
    return [hashlib.blake2b(raw[e - 8 * c : e], digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), counts.tolist())]


def _firsts(prints: list) -> np.ndarray:
    """The first text of each distinct set."""
    seen: dict = {}
    for i, p in enumerate(prints):
        if p is not None:
            seen.setdefault(p, i)
    return np.array(sorted(seen.values()), np.int64)


def _group_tokens(table: pa.Table, text: str, size: int):
    rows, keys, counts = _sets(table.column(text), size)
    prints = _prints(keys, counts)
    firsts = _firsts(prints)
    chosen = np.zeros(len(counts), bool)
    chosen[firsts] = True
    mine = chosen[rows] if len(rows) else np.zeros(0, bool)
    return rows, keys, counts, prints, firsts, mine


def _shared_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, group_bytes: int, carry: list[str], keep_text: bool = False) -> DataFrame:
    """A row for each document: row (a number of its own), id, the text if it is kept, the carried columns as c0, c1, ..., n, fp, and for those that may have partners their shared tokens and prefixes."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    kept = ["id", *["text"] * keep_text, *[f"c{i}" for i in range(len(carry))]]
    n_bytes = total_bytes(narrow, "text")
    bits = max(3, (pieces(n_bytes, group_bytes) - 1).bit_length())
    shift = np.uint64(64 - bits)
    packed = pack(narrow, ["id", "text"], pieces(n_bytes, group_bytes))

    def uniques(keys):
        uniq, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return uniq, inverse, counts, (uniq >> shift).astype(np.int64)

    def extract(table):
        _, keys, _, _, _, mine = _group_tokens(group_rows(table, ["id", "text"]), "text", size)
        uniq, _, counts, bucket = uniques(keys[mine])
        low = (uniq << np.uint64(bits)) >> np.uint64(24)  # 40 bits below those of the bucket
        out = []
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(bucket)]):
            parts = (low[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (low[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), squeeze(counts[a:b].astype("<u4"))
            out.append((int(bucket[a]), int(b - a).to_bytes(8, "little") + b"".join(parts)))
        return out

    def reply(payloads):
        lows, counts, sizes = [], [], []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            low = np.frombuffer(p, "<u4", n, 8).astype(np.uint64) | (np.frombuffer(p, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32))
            lows.append(low)
            counts.append(unsqueeze(p[8 + 5 * n :], "<u4"))
            sizes.append(n)
        _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        df = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
        rank = np.where(df < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(df, 2))))).astype(np.uint8)
        return [squeeze(x) for x in np.split(rank, np.cumsum(sizes)[:-1])]

    def finish(table, replies):
        docs_of = group_rows(table, ["id", "text"])
        rows, keys, counts, prints, firsts, mine = _group_tokens(docs_of, "text", size)
        uniq, inverse, _, _ = uniques(keys[mine])
        rank = np.concatenate([unsqueeze(replies[b], np.uint8) for b in sorted(replies)]) if replies else np.zeros(0, np.uint8)
        if len(rank) != len(uniq):
            raise ValueError("answers do not match the questions of a group")
        rank, rows, keys = rank[inverse], rows[mine], keys[mine]
        prefix = counts - (percent * counts + 99) // 100 + 1
        prefix = prefix - np.bincount(rows[rank == 0], minlength=len(counts))
        keep = (rank > 0) & (prefix[rows] > 0)
        rank, rows, keys = rank[keep], rows[keep], keys[keep]
        taken = np.bincount(rows, minlength=len(counts))
        begin = np.cumsum(taken) - taken

        def leading(order):
            """The prefix of each text in this order of its shared tokens."""
            r, k = rows[order], keys[order]
            head = np.arange(len(r)) - begin[r] < prefix[r]
            return k[head], np.bincount(r[head], minlength=len(counts))

        def lists(values, lengths, kind, dtype):
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(dtype), kind), mask=pa.array(lengths == 0))

        row = table.column("grp")[0].as_py() * 2**32 + np.arange(len(counts))
        columns = [pa.array(row, pa.int64()), *[docs_of.column(c) for c in kept], pa.array(counts, pa.int64()), pa.array(prints, pa.binary())]
        columns.append(lists(keys, taken, pa.int64(), np.int64))
        columns.append(lists(*leading(np.lexsort((keys, rank, rows))), pa.int64(), np.int64))
        for j in range(MORE_ORDERS):
            k, lengths = leading(np.lexsort((mix(keys, 101 + j), rows)))
            columns.append(lists(k.astype(np.uint32), lengths, pa.int32(), np.int32))
        return pa.table(dict(zip(names, columns)))

    schema = T.StructType([T.StructField("row", T.LongType()), *[narrow.schema[c] for c in kept], T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("p0", T.ArrayType(T.LongType()))])
    for j in range(MORE_ORDERS):
        schema.add(T.StructField(f"p{j + 1}", T.ArrayType(T.IntegerType())))
    names = schema.names
    routes = Routes(pieces(n_bytes, group_bytes), 1 << bits)
    return routes.resolve(packed, routes.answer(routes.ask(packed, extract), reply), finish, schema)


def _comparable(x: str, y: str, percent: int):
    """Sizes that can reach the threshold at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those that share a prefix token under every other order and reach the threshold."""
    more = [f"p{j + 1}" for j in range(MORE_ORDERS)]
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("fp", "n", "tokens", *more)])
    a, b = side("a"), side("b")
    both = pairs.join(a, pairs.a == a.fp_a).select("a", "b", "n_a", "tokens_a", *[f"{p}_a" for p in more])
    on = both.b == b.fp_b
    for p in more:
        on = on & F.arrays_overlap(f"{p}_a", f"{p}_b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.join(b, on).where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


class _Lists:
    """A list column as flat values; the values of some rows together with whose they are."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.values, self.length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(rows)), n), self.values[at]

    def common(self, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
        """How many values each of the rows a has in common with each of the rows b, as matrix products."""
        (whose_a, in_a), (whose_b, in_b) = self.of(a), self.of(b)
        out = np.zeros((len(a), len(b)), np.float32)
        shared = np.intersect1d(in_a, in_b)
        for lo in range(0, len(shared), step):
            some = shared[lo : lo + step]
            p, q = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
            for m, whose, values in ((p, whose_a, in_a), (q, whose_b, in_b)):
                at = np.minimum(np.searchsorted(some, values), len(some) - 1)
                hit = some[at] == values
                m[whose[hit], at[hit]] = 1
            out += p @ q.T
        return out


def _in_blocks(left: DataFrame, right: DataFrame, nodes: DataFrame, percent: int, all_links: bool = False) -> DataFrame:
    """The links (a, b) of the nodes left(g, fp, comp) to the nodes right(g, fp, comp) of the same g in other components.

    Both sides of a g are dealt to blocks, and each pair of blocks is compared in one task: candidates
    must share a prefix token under every other order, then common tokens are counted by a matrix
    product. Only links are returned, so nothing is emitted for pairs that fail; and of a node's
    links to one component one is enough, unless `all_links` are wanted.
    """
    sizes = left.groupBy("g").agg(F.count("*").alias("l")).join(right.groupBy("g").agg(F.count("*").alias("r")), "g")
    sizes = sizes.select("g", F.ceil(F.col("l") / BLOCK).cast("int").alias("li"), F.ceil(F.col("r") / BLOCK).cast("int").alias("rj"))
    at = lambda blocks, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(blocks).cast("long")).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    sides = left.join(sizes, "g").withColumn("side", F.lit(0)).withColumn("i", at("li", 1)).withColumn("j", upto("rj"))
    sides = sides.unionByName(right.join(sizes, "g").withColumn("side", F.lit(1)).withColumn("j", at("rj", 2)).withColumn("i", upto("li")))
    dealt = Frozen(sides.select("side", "fp", "comp", F.xxhash64("g", "i", "j").alias("block")))
    bins = pieces(dealt.df.count(), ROWS)
    more = [f"p{j + 1}" for j in range(MORE_ORDERS)]
    whole = dealt.df.join(nodes.select("fp", "n", "tokens", *more), "fp").withColumn("bin", F.pmod("block", F.lit(bins)))

    def compare(table):
        side, n, block = (table.column(c).to_numpy() for c in ("side", "n", "block"))
        fp = table.column("fp").to_pylist()
        comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        lists, orders = _Lists(table.column("tokens")), [_Lists(table.column(p)) for p in more]
        order = np.lexsort((side, block))
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            a, b = rows[side[rows] == 0], rows[side[rows] == 1]
            if not len(a) or not len(b):
                continue
            apart = (comp[a][:, None] != comp[b][None, :]) | (all_links & (a[:, None] != b[None, :]))
            most = np.minimum(lists.length[a][:, None], lists.length[b][None, :])  # tokens of one document alone are common to no two
            apart &= 100 * most >= percent * (n[a][:, None] + n[b][None, :] - most)
            for o in orders:
                if not apart.any():
                    break
                apart &= o.common(a, b) > 0
            if not apart.any():
                continue
            a, b, apart = a[apart.any(1)], b[apart.any(0)], apart[apart.any(1)][:, apart.any(0)]
            both = lists.common(a, b)
            u, v = np.nonzero(apart & (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)))
            u, v = a[u], b[v]
            if not all_links and len(u):
                first = np.unique(np.stack([u, comp[v]], 1), axis=0, return_index=True)[1]
                u, v = u[first], v[first]
            out += [(min(fp[x], fp[y]), max(fp[x], fp[y])) for x, y in zip(u, v) if fp[x] != fp[y]]
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return whole.repartition(parts_of(bins), "bin").groupBy("bin").applyInArrow(compare, "a binary, b binary").distinct()


def _nodes(found: DataFrame) -> Frozen:
    """The distinct sets that may have partners, written by fp so that joins on fp move the other side alone."""
    sets = found.where("p0 is not null").select("fp", "n", "tokens", "p0", *[f"p{j + 1}" for j in range(MORE_ORDERS)])
    n_bytes = 12 * (found.where("p0 is not null").agg(F.sum("n")).first()[0] or 0)
    buckets = max(8, pieces(n_bytes, 32 << 20))
    return Frozen(sets.repartition(buckets, "fp").dropDuplicates(["fp"]), clean=True, bucket=("fp", buckets))


def _groups(nodes: DataFrame, percent: int) -> DataFrame:
    """(t, fp, n, near, early) of nodes that share a prefix token of the first order and may reach the threshold with it as first common token.

    `early` tells that the token stands in the first (1 - t) / (1 + t) of the set. Nodes that no early
    node of their token fits by size and by what is left behind the token are left out. Of tokens
    with the same nodes, equally early, one is enough.
    """
    # a set with few tokens of its own is nearer to the middle of its group, and so a better pivot
    near = F.floor(16 * F.size("p0") / F.col("n")).cast("int")
    placed = nodes.select("fp", "n", near.alias("near"), (F.col("n") - F.size("tokens")).alias("own"), F.posexplode("p0").alias("i", "t"))
    left = F.col("n") - F.col("own") - F.col("i")  # what the set has from the token on
    placed = placed.select("t", "fp", "n", "near", left.alias("left"), ((100 + percent) * (F.col("own") + F.col("i")) <= (100 - percent) * F.col("n")).alias("early"))
    early = F.when(F.col("early"), F.col("n"))
    ends = placed.groupBy("t").agg(F.count("*").alias("c"), F.min(early).alias("low"), F.max(early).alias("high"), F.min("n").alias("least"), F.max("n").alias("most")).where("c > 1 and low is not null").drop("c")
    low, high = F.when(F.col("early"), F.col("least")).otherwise(F.col("low")), F.when(F.col("early"), F.col("most")).otherwise(F.col("high"))
    fits = (100 * high >= percent * F.col("n")) & (percent * low <= 100 * F.col("n")) & (percent * (F.greatest(low, F.ceil(percent * F.col("n") / 100)) + F.col("n")) <= (100 + percent) * F.col("left"))
    members = placed.join(ends, "t").where(fits).select("t", "fp", "n", "near", "early")
    return members.join(_distinct_groups(members, "t"), "t")


def _distinct_groups(members: DataFrame, t: str) -> DataFrame:
    """Of the tokens with several nodes and an early one, one for each set of (node, early); sets are told apart by their number and 128 bits."""
    marks = [F.bit_xor(F.xxhash64("fp", "early", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    return members.groupBy(t).agg(F.count("*").alias("c"), F.max("early").alias("e"), *marks).where("c > 1 and e").groupBy("c", "x1", "x2").agg(F.min(t).alias(t)).select(t)


def _unsettled(members: DataFrame, parts: Components) -> Frozen:
    """Members with their component so far (their own set where they have none), of groups that hold several components."""
    placed = members.drop("comp").join(parts.df, F.col("fp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "fp")).drop("node", "component")
    mixed = placed.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("t")
    return Frozen(placed.join(mixed, "t"))


def _joined(parts: Components | None, links: DataFrame) -> Components:
    """Components after more links."""
    before = parts.df.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links) if parts else links
    after = connected_components(before)
    if parts:
        parts.drop()
    return after


def _components(nodes: DataFrame, percent: int) -> tuple[Components, list[Frozen]]:
    """(node, component) of all nodes that have links, and the links that were found on the way."""
    members = Frozen(_groups(nodes, percent).withColumn("comp", F.col("fp")))
    links, parts = [], None
    for turn in range(STAR_TURNS):
        pivots = members.df.groupBy("t").agg(F.max(F.struct("early", "near", F.xxhash64("fp", F.lit(turn)).alias("h"), "fp", "n", "comp")).alias("p"))
        starred = members.df.join(pivots, "t").where((F.col("comp") != F.col("p.comp")) & _comparable("n", "p.n", percent))
        links.append(Frozen(_verified(starred.select(F.col("p.fp").alias("a"), F.col("fp").alias("b")).distinct(), nodes, percent), clean=True))
        parts = _joined(parts, links[-1].df)
        before, members = members, _unsettled(members.df, parts)
        before.drop()
    sizes = members.df.groupBy("t", "comp").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "comp")).alias("m")).select("t", F.col("m.comp").alias("main"))
    placed = Frozen(members.df.select("t", "fp", "comp", "early").join(sizes, "t"))
    outside, inside = placed.df.where("comp != main"), placed.df.where("comp = main")
    # a token's nodes outside its main component with those inside: early ones with all, late ones with early ones
    kinds = outside.groupBy("t").agg(F.max("early").alias("some_early"), F.max(~F.col("early")).alias("some_late"))
    inside = inside.join(kinds, "t")
    side = lambda df, mark: df.select(F.concat("main", F.lit(mark).cast("binary")).alias("g"), "fp", "comp").distinct()
    lefts = side(outside.where("early"), "early").unionByName(side(outside.where("not early"), "late"))
    rights = side(inside.where("some_early"), "early").unionByName(side(inside.where("early and some_late"), "late"))
    mixed = outside.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("t")
    apart = outside.join(mixed, "t")
    apart = apart.join(_distinct_groups(apart, "t"), "t").select(F.encode(F.col("t").cast("string"), "utf-8").alias("g"), "fp", "comp", "early")
    left, right = Frozen(lefts.unionByName(apart.where("early").drop("early"))), Frozen(rights.unionByName(apart.drop("early")))
    links.append(Frozen(_in_blocks(left.df, right.df, nodes, percent), clean=True))
    parts = _joined(parts, links[-1].df)
    for x in (members, placed, left, right):
        x.drop()
    return parts, links


def _search(docs, id_col, text_col, size, percent, group_bytes, carry, keep_text=False):
    found = Frozen(_shared_sets(docs, id_col, text_col, size, percent, group_bytes, carry, keep_text), clean=True)
    nodes = _nodes(found.df)
    rows = found
    if not carry and not keep_text:  # the sets are with the nodes now
        rows = Frozen(found.df.select("row", "id", "n", "fp"))
        found.drop()
    return rows, nodes


def _own_sets(rows: DataFrame, parts: Components) -> DataFrame:
    """(fp, first, component) of each distinct set: its smallest id, and its component or itself."""
    own = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first"))
    return own.join(parts.df, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, group_bytes: int = 8 << 20) -> DataFrame:
    """Documents linked when 100 * |A and B| >= percent * |A or B| over their `size`-word shingles.

    Returns for each row of docs: id_col, n_shingles, component_id, n_links_found. component_id is
    the smallest id reachable by links, the row's own included. n_links_found counts the verified
    links of the row's set to other sets that the search needed, not all there are (jaccard_links gives all).

    Null or empty text: no shingles, linked with nothing, component_id is its own id. A null id: the
    row is returned; it takes its set's smallest other id, or null. Rows that repeat an id are rows of
    their own. Ties, copies: equal sets are always linked. An empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    rows, nodes = _search(docs, id_col, text_col, size, percent, group_bytes, [])
    parts, links = _components(nodes.df, percent)
    nodes.drop()
    own = _own_sets(rows.df, parts)
    lowest = own.groupBy("component").agg(F.min("first").alias("component_id"))
    ends = links[0].df
    for x in links[1:]:
        ends = ends.unionByName(x.df)
    degree = ends.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    of_set = own.select("fp", "component").join(lowest, "component").join(degree, "fp", "left").select(F.col("fp").alias("__fp"), "component_id", "links")
    out = rows.df.join(of_set, F.col("fp") == F.col("__fp"), "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").cast(kind).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links_found"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, group_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs without near copies: of each component of linked rows, exactly one row stays, with all columns.

    The row with the smallest id stays; null ids come last, and of repeated ids any one row. Rows
    without words are linked with nothing and stay. An empty table gives an empty one. Column names
    do not matter. A third of all rows may be one component: its best row is found by partial minima.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    rows, nodes = _search(docs, id_col, text_col, size, percent, group_bytes, carry, keep_text=True)
    parts, links = _components(nodes.df, percent)
    for x in (nodes, *links):
        x.drop()
    placed = rows.df.where("fp is not null").select("row", "id", "fp").join(parts.df, F.col("fp") == F.col("node"), "left").select("row", "id", F.coalesce("component", "fp").alias("component"))
    placed = Frozen(placed)
    best = placed.df.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("b")).select("component", F.col("b.row").alias("best"))
    # written, so that its size is known: where it is small, texts are not shuffled to leave its rows out
    lost = Frozen(placed.df.join(best, "component").where("row != best").select("row"))
    placed.drop()
    names = {id_col: "id", text_col: "text"} | {c: f"c{i}" for i, c in enumerate(carry)}
    return rows.df.join(lost.df, "row", "left_anti").select(*[F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, group_bytes: int = 8 << 20, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as (members, links): members has id_col, set_id and the columns named in `carry` for each row, links has pairs of set ids (a < b).

    set_id is the set's 128-bit fingerprint; copies share it and are not expanded into pairs. Rows
    without words have a null set_id. Null, tied and repeated ids are rows of their own. The links of a
    large group of near copies grow with its square, as the result does.
    """
    carry = carry or []
    rows, nodes = _search(docs, id_col, text_col, size, percent, group_bytes, carry)
    grouped = Frozen(_groups(nodes.df, percent).select(F.encode(F.col("t").cast("string"), "utf-8").alias("g"), "fp", F.col("fp").alias("comp"), "early"))
    links = Frozen(_in_blocks(grouped.df.where("early").drop("early"), grouped.df.drop("early"), nodes.df, percent, all_links=True))
    grouped.drop()
    nodes.drop()
    return rows.df.select(F.col("id").alias(id_col), F.col("fp").alias("set_id"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]), links.df
