"""Jaccard self-join of word n-grams by token-combination prefixes.

Two sets of similarity ``t`` differ in few tokens, so in any fixed order of all tokens their prefixes share some.
Tokens are ordered by how many documents hold them (counted in hashed cells over the whole corpus). Rare tokens
of a prefix are signatures by themselves. Frequent ones are not selective; they are dealt into groups by hash, the
prefix is extended, and pairs of frequent tokens of one group are the signatures. A group of ``g`` tokens keeps a
common pair until ``g - 1`` of them differ, so a prefix whose rare tokens and ``g - 1`` of every group add up to
one more than the allowed differences cannot miss a similar set. Nothing is capped.

Equal sets are one node throughout. Nodes with a common signature are first compared with one of them only
(the leader), which costs one pair per node and signature. Two nodes of one leader that are not both linked
to it are found from their differences to the leader: similar nodes have mostly the same difference, so their
difference prefixes meet, while nodes that differ from the leader in other places never do. So a family of
thousands of near copies does not become all its pairs, and no link between parts of the graph is lost.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitfilter import BitFilter, build, mix
from plumbline.llm.common import slices, staged, text_of

#: cells with more documents than this hold frequent tokens
FREQUENT = 64
#: most cells counted, as a power of two; more tokens make the order coarser, never the result
CELL_BITS = 26
#: cells handed from task to task at once
CHUNK_BITS = 16

_P, _Q, _R = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words``-word shingles are linked at ``percent`` of intersection over union."""

    words: int = 5
    percent: int = 80

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)

    def spare(self, n: int) -> int:
        """Tokens of a set of ``n`` that a linked set may lack."""
        return n - -(-n * self.percent // 100)

    def apart(self, total):
        """Most differing tokens of two linked sets with ``total`` tokens."""
        return total * (100 - self.percent) // (100 + self.percent)

    def size_class(self, n: int) -> int:
        return int(np.log(n) / (2 * np.log(100 / self.percent)) + 1e-9)

    def groups(self, size_class: int) -> int:
        """Groups of frequent tokens for sets of a size class: about four tokens of a prefix fall in each."""
        smallest = int(np.exp(size_class * 2 * np.log(100 / self.percent)) - 1e-6)
        return max(1, self.spare(max(smallest, 1)) // 3)


def _shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, without words none."""
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    n = len(own)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh64_intdigest, own), dtype=np.uint64, count=n)
    width = min(words, n)
    out = np.full(n - width + 1, _R + np.uint64(width))
    for k in range(width):
        out = mix(out * _P + h[k : n - width + 1 + k] + _Q)
    return np.unique(out)


def _node(tokens: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number; 0 for the empty set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes()) | 1).view(np.int64)) if len(tokens) else 0


def _sets_and_cells(rows: DataFrame, like: Likeness, bits: int) -> DataFrame:
    """One row per document (its node and size), and per task the packed document counts of its token cells."""
    kind = dict(rows.dtypes)["doc_id"]
    chunk = min(CHUNK_BITS, bits)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        counts = np.zeros(1 << bits, dtype=np.uint16)
        empty = None
        for batch in (part for whole in batches for part in slices(whole)):
            nodes, sizes, held, size = [], [], [], 0
            empty = batch.column("doc_id").slice(0, 0)

            def add(held):
                cell, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
                cell = cell.astype(np.int64)
                counts[cell] = np.minimum(counts[cell] + n, 65_535)

            for text in batch.column("text").to_pylist():
                tokens = _shingles(text, like.words)
                nodes.append(_node(tokens))
                sizes.append(len(tokens))
                held.append(tokens)
                size += len(tokens)
                if size > 2_000_000:
                    add(held)
                    held, size = [], 0
            if held:
                add(held)
            none = pa.nulls(len(nodes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), none, none, pa.nulls(len(nodes), pa.binary())],
                names=["doc_id", "node", "n", "part", "chunk", "cells"],
            )
        if empty is not None:
            part = TaskContext.get().partitionId()
            for k in range(1 << (bits - chunk)):
                cells = np.minimum(counts[k << chunk : (k + 1) << chunk], 255).astype(np.uint8)
                if cells.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, empty.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()),
                         pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())],
                        names=["doc_id", "node", "n", "part", "chunk", "cells"],
                    )

    return rows.mapInArrow(run, f"doc_id {kind}, node long, n int, part int, chunk int, cells binary")


def _cells(packed: DataFrame, bits: int) -> np.ndarray:
    """Sum of all tasks' counts (up to 255), in rounds that join at most 64 parts of a chunk in a task."""

    def join(table):
        import pyarrow as pa

        total = 0
        for one in table.column("cells"):
            total = np.minimum(total + np.frombuffer(zlib.decompress(one.as_py()), dtype=np.uint8).astype(np.int32), 255)
        return pa.table(
            {"part": table.column("slot").slice(0, 1), "chunk": table.column("chunk").slice(0, 1),
             "cells": pa.array([zlib.compress(total.astype(np.uint8).tobytes(), 1)], pa.binary())}
        )

    slots = packed.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while True:
        slots = -(-slots // 64)
        packed = packed.withColumn("slot", F.pmod("part", F.lit(slots)).cast("int")).groupBy("chunk", "slot").applyInArrow(
            join, "part int, chunk int, cells binary"
        )
        if slots == 1:
            break
    chunk = min(CHUNK_BITS, bits)
    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in packed.collect():  # together at most 2 ** CELL_BITS bytes
        own = np.frombuffer(zlib.decompress(row["cells"]), dtype=np.uint8)
        out[row["chunk"] << chunk : (row["chunk"] << chunk) + len(own)] = own
    return out


def _signatures(tokens: np.ndarray, cells: np.ndarray, like: Likeness) -> np.ndarray:
    """Signatures of one set, for its size class and for the next smaller one if a linked set may be in it."""
    n, shift = len(tokens), np.uint64(64 - (len(cells).bit_length() - 1))
    df = cells[(tokens >> shift).astype(np.int64)]
    order = np.lexsort((tokens, df))
    rare = int((df <= FREQUENT).sum())
    want = like.spare(n) + 1
    out = []
    high = like.size_class(n)
    for c in range(like.size_class(n - like.spare(n)), high + 1):
        salt = mix(np.array([c + 1], dtype=np.uint64) * _R)
        out.append(mix(tokens[order[: min(want, rare)]] + salt))
        missing = want - rare
        if missing > 0:
            groups, members, pairs = like.groups(c), {}, []
            for token in tokens[order[rare:]].tolist():
                own = members.setdefault((token >> 7) % groups, [])
                if own:
                    pairs += [(token, other) for other in own]
                    missing -= 1
                own.append(token)
                if not missing:
                    break
            if pairs:
                two = np.sort(np.array(pairs, dtype=np.uint64), axis=1)
                out.append(mix(mix(two[:, 0] * _P + two[:, 1]) ^ (salt + _Q)))
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def _signature_cells(rows: DataFrame, like: Likeness, cells, bits: int) -> DataFrame:
    """Per task the packed counts (up to 2) of documents by cell of their signatures."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        counts, any_row = np.zeros(1 << bits, dtype=np.uint8), False
        for batch in (part for whole in batches for part in slices(whole)):
            any_row = True
            sets = (_shingles(text, like.words) for text in batch.column("text").to_pylist())
            own = [_signatures(tokens, cells.value, like) >> np.uint64(64 - bits) for tokens in sets if len(tokens)]
            if own:
                cell, n = np.unique(np.concatenate(own), return_counts=True)
                cell = cell.astype(np.int64)
                counts[cell] = np.minimum(counts[cell] + np.minimum(n, 2), 2)
        chunk = min(CHUNK_BITS, bits)
        for k in range(1 << (bits - chunk) if any_row else 0):
            own = counts[k << chunk : (k + 1) << chunk]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())],
                    names=["part", "chunk", "cells"],
                )

    return rows.select("text").mapInArrow(run, "part int, chunk int, cells binary")


def _signed(rows: DataFrame, like: Likeness, cells, repeated=None, sifted=None) -> DataFrame:
    """Signatures of all sets (without those alone in their cell, if cells are ``sifted``); with a filter of
    ``repeated`` ones only those, and then also the tokens of these sets."""

    def run(batches):
        import pyarrow as pa

        freq, seen, sent = cells.value, None if repeated is None else repeated.value, set()
        for batch in (part for whole in batches for part in slices(whole)):
            sig, node, size, blob = [], [], [], []
            held = 0

            def made():
                lens = [len(s) for s in sig]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.repeat(np.array(node, np.int64), lens)),
                     pa.array(np.repeat(np.array(size, np.int32), lens)), pa.array([b[0] for own in blob for b in own], pa.binary()),
                     pa.array([b[1] for own in blob for b in own], pa.binary())],
                    names=["sig", "node", "n", "tokens", "shape"],
                )

            for text in batch.column("text").to_pylist():
                tokens = _shingles(text, like.words)
                if len(tokens) < 1:
                    continue
                own = _signatures(tokens, freq, like)
                if sifted is not None:
                    held_by = sifted.value
                    own = own[held_by[(own >> np.uint64(64 - (len(held_by).bit_length() - 1))).astype(np.int64)] > 1]
                if seen is not None:
                    own = own[seen.holds(own)]
                if not len(own):
                    continue
                sig.append(own)
                node.append(_node(tokens))
                size.append(len(tokens))
                # the set itself goes with its first signature
                fresh = seen is not None and node[-1] not in sent
                sent.add(node[-1])
                blob.append([(_packed(tokens), _shape(tokens)) if fresh else (None, None)] + [(None, None)] * (len(own) - 1))
                held += len(own) + (len(tokens) if seen is not None else 0)
                if held > 1_000_000:
                    yield made()
                    sig, node, size, blob, held = [], [], [], [], 0
            if sig:
                yield made()

    return rows.select("text").mapInArrow(run, "sig long, node long, n int, tokens binary, shape binary")


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens as their high 48 bits, which is what sets are compared by: two sets of a thousand tokens have
    a chance of about 4e-9 that two different ones look equal."""
    return np.ascontiguousarray((tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data) -> np.ndarray:
    own = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(own), 8), dtype=np.uint8)
    out[:, 2:] = own
    return out.view("<u8").ravel()


def _stars(held: DataFrame) -> DataFrame:
    """``leader, member``: every holder of a signature (``sig, node, size``) with the best connected of its holders.

    That is the node whose signatures have most holders in all, so a family of near copies has few leaders, from
    its own middle, and a chance meeting with another text does not move them.
    """
    weight = held.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = held.select("sig", "node").join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    met = held.join(leaders, "sig").filter("node != leader").select("leader", F.col("node").alias("member"), (F.col("size") > 2).alias("wide"))
    return met.groupBy("leader", "member").agg(F.max("wide").alias("wide"))


def _shape(tokens: np.ndarray) -> bytes:
    """Tokens by the low byte of their hash, counted up to 255."""
    return np.minimum(np.bincount((tokens & np.uint64(0xFF)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _near_enough(pairs: DataFrame, shapes: DataFrame, like: Likeness) -> DataFrame:
    """Without the pairs that only met in signatures of two holders and cannot be linked.

    The summed difference of two shapes is at most the number of tokens that the sets do not share. A signature of
    two holders is about this one pair, so nothing else depends on it.
    """
    left = shapes.select(F.col("node").alias("leader"), F.col("n").alias("n_a"), F.col("shape").alias("a"))
    right = shapes.select(F.col("node").alias("member"), F.col("n").alias("n_b"), F.col("shape").alias("b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 256).astype(np.int32) for c in "ab")
                most = like.apart(batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy())
                near = pa.array(np.abs(a - b).sum(axis=1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column("leader").filter(near), batch.column("member").filter(near)], names=["leader", "member"])

    narrow = pairs.filter(~F.col("wide")).select("leader", "member").join(left, "leader").join(right, "member")
    near = narrow.select("leader", "member", "n_a", "n_b", "a", "b").mapInArrow(run, "leader long, member long")
    return pairs.filter("wide").select("leader", "member").unionByName(near)


def _compare(pairs: DataFrame, sets: DataFrame, like: Likeness, cells, deltas: bool) -> DataFrame:
    """Exact comparison of ``leader`` and ``member``: ``linked``, and the first tokens of their difference if asked for."""
    # a member has at most as many leaders as it has signatures, so its set travels to their place only
    leaders = pairs.groupBy("member").agg(F.collect_set("leader").alias("leaders"))
    own = sets.join(leaders, F.col("node") == F.col("member")).select("member", F.col("tokens").alias("member_tokens"), F.explode("leaders").alias("leader"))
    lead = sets.join(pairs.select("leader").distinct(), F.col("node") == F.col("leader")).select("leader", F.col("tokens").alias("leader_tokens"))
    both = own.join(lead, "leader")

    def run(batches):
        import pyarrow as pa

        freq = cells.value
        shift = np.uint64(64 - (len(freq).bit_length() - 1))
        for batch in batches:
            linked, size, apart, prefix = [], [], [], []
            for one, two in zip(batch.column("leader_tokens"), batch.column("member_tokens"), strict=True):
                a, b = _unpacked(one.as_buffer()), _unpacked(two.as_buffer())
                new = np.setdiff1d(b, a, assume_unique=True)
                shared = len(b) - len(new)
                linked.append(bool(like.linked(shared, len(a), len(b))))
                size.append(len(b))
                apart.append(len(a) + len(b) - 2 * shared)
                first = None
                if deltas:
                    # tokens the leader lacks come first, so members are told apart by what is their own
                    most = min(apart[-1], len(b) * (100 - like.percent) // like.percent + 1)
                    gone = np.setdiff1d(a, b, assume_unique=True) if len(new) < most else a[:0]
                    rank = lambda x: x[np.lexsort((x, freq[(x >> shift).astype(np.int64)]))]
                    first = np.r_[rank(new), rank(gone)][:most].view(np.int64).tolist()
                prefix.append(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("leader"), batch.column("member"), pa.array(linked, pa.bool_()), pa.array(size, pa.int32()),
                 pa.array(apart, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["leader", "member", "linked", "n", "apart", "prefix"],
            )

    columns = both.select("leader", "member", "leader_tokens", "member_tokens")
    return columns.mapInArrow(run, "leader long, member long, linked boolean, n int, apart int, prefix array<long>")


def _through_differences(stars: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of one leader's members, not both linked to it, whose difference prefixes meet where linked sets must."""
    loose = stars.filter(~F.col("linked")).select("leader").distinct()
    parts = stars.join(loose, "leader").select("leader", "member", "linked", "n", "apart", F.posexplode("prefix").alias("place", "token"))
    a, b = parts.alias("a"), parts.alias("b")
    total = F.col("a.n") + F.col("b.n")
    both = F.col("a.apart") + F.col("b.apart")
    most = total * (100 - like.percent) / (100 + like.percent)
    need = F.ceil((both - most) / 2 - 1e-9)
    near = (
        (F.col("a.leader") == F.col("b.leader")) & (F.col("a.token") == F.col("b.token"))
        & (F.col("a.member") != F.col("b.member"))
        & ~F.col("a.linked") & (F.col("b.linked") | (F.col("a.member") < F.col("b.member")))
        & (F.abs(F.col("a.apart") - F.col("b.apart")) <= most)
        & (F.col("a.place") + need <= F.col("a.apart")) & (F.col("b.place") + need <= F.col("b.apart"))
        & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * like.percent)
    )
    ends = (F.least("a.member", "b.member").alias("leader"), F.greatest("a.member", "b.member").alias("member"))
    return a.join(b, near).select(*ends).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("leader").alias("node")).unionByName(pairs.select(F.col("member").alias("node")))


def _tokens_of(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, tokens`` of all sets that occur in the pairs."""
    ends = staged(_ends(pairs).distinct(), "ends")
    # 8 bytes each: few enough to send to all tasks, or a join
    ends = F.broadcast(ends) if ends.count() <= 1_000_000 else ends
    return signed.filter("tokens is not null").join(ends, "node", "left_semi").groupBy("node").agg(F.min("tokens").alias("tokens"))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that has a link (``leader``, ``member``).

    Each node in turn hands its smallest neighbour to the others, on both sides, until every node hangs on its
    root directly; rounds grow with the logarithm of the longest chain, and each is written before the next.
    """
    edges = staged(links.select(F.greatest("leader", "member").alias("u"), F.least("leader", "member").alias("v")).filter("u != v").distinct(), "links")
    while True:
        # larger neighbours of a node get its smallest neighbour
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # then the smaller neighbours of a node, and the node, get the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = staged(small.filter("u != v").distinct(), "links")
        look = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        done = look(after) == look(edges)
        edges = after
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def classes(docs: DataFrame, like: Likeness = Likeness(), doc_id: str = "doc_id", text: str = "text", sift: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, set_id, n_links, component_id``.

    ``component_id`` is the smallest id reachable by links, its own included; ``n_links`` counts the confirmed
    links of the document's set that the search needed (a spanning part of all links). Words are lower-cased A-Z
    and blank-separated. A text with fewer words than a shingle is one shingle; without words (or null) a set is
    empty and linked with nothing. With ``sift`` signatures are first counted in cells, and those alone in theirs
    are not shuffled: one more pass over the texts for less disk, with the same result. Ids may repeat: equal ids do not link different texts. A null id is never the
    smallest; a component of null ids alone has a null id. Other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(max(int(size // 48).bit_length(), 12), CELL_BITS)
    first = staged(_sets_and_cells(rows, like, bits), "sets")
    sets = first.filter("chunk is null").select("doc_id", "node", "n")
    cells = spark.sparkContext.broadcast(_cells(first.filter("chunk is not null").select("part", "chunk", "cells"), bits))

    sifted = None
    if sift:
        wide = min(bits + 3, CELL_BITS)
        sifted = spark.sparkContext.broadcast(_cells(staged(_signature_cells(rows, like, cells, wide), "signature-cells"), wide))
    seen = _signed(rows, like, cells, sifted=sifted).groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("size"))
    shared = staged(seen.filter("a < b").select("sig", "size"), "signatures")
    repeated = spark.sparkContext.broadcast(build(shared, "sig", BitFilter.sized(shared.count())))
    signed = staged(_signed(rows, like, cells, repeated), "candidates")
    met = staged(_stars(signed.select("sig", "node").distinct().join(shared, "sig")), "met")
    shapes = signed.filter("shape is not null").groupBy("node", "n").agg(F.min("shape").alias("shape"))
    pairs = staged(_near_enough(met, shapes, like), "pairs")
    tokens = _tokens_of(signed, pairs)
    stars = staged(_compare(pairs, tokens, like, cells, True), "stars")
    rest = staged(_through_differences(stars, like), "rest")
    more = _compare(rest, _tokens_of(signed, rest), like, cells, False)
    links = staged(stars.unionByName(more).filter("linked").select("leader", "member"), "links")
    roots = components(links)
    degree = _ends(links).groupBy("node").agg(F.count("*").alias("n_links"))

    kinds = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = kinds.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(lowest, "root").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    filled = sets.filter("n > 0").join(labels, "node").select("doc_id", "n", "node", "n_links", "component_id")
    empty = sets.filter("n = 0").select("doc_id", "n", "node", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("node").alias("set_id"), "n_links", "component_id")


def keep_one(docs: DataFrame, like: Likeness = Likeness(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component; texts without words all stay.

    Rows that repeat an id and a set count as copies, and one of them stays.
    """
    found = classes(docs, like, doc_id, text, sift=True)
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max(stays).alias("stays")).filter("not stays").select("__id")
    kept = _without(docs, staged(gone, "gone"), doc_id)
    again = found.filter("n_shingles > 0").groupBy("doc_id", "set_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates([doc_id, text]) if again else kept


def _without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """The rows whose id is not in ``gone`` (``__id``); only rows that a filter of these ids holds are moved to compare."""
    keys = gone.select(F.xxhash64("__id").alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(build(keys, "key", BitFilter.sized(gone.count())))

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(keys.to_numpy().view(np.uint64)))

    may_go = held(F.xxhash64(F.col(f"`{doc_id}`")))
    compared = docs.filter(may_go)
    return docs.filter(~may_go).unionByName(compared.join(gone, compared[f"`{doc_id}`"].eqNullSafe(gone["__id"]), "left_anti"))
