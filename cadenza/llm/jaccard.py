"""N-gram Jaccard join with a token-group matrix.

Documents are sets of distinct word n-grams (64-bit hashes). The join

1. partitions similar documents into groups: equal least hash over the more frequent half of the set (copies
   of one text keep its grams there, whatever was edited), large groups cut into blocks of about
   ``BLOCK_TOKENS`` grams by a hash of the set;
2. stores each group's token union, the token-group matrix: rows (token, block, smallest and largest
   member set). Only the tokens that can decide are stored: with all grams in one common order, rare
   first, two sets that overlap in ``a`` grams share ``k`` of their first ``n - a + k`` grams;
3. bounds each query group's overlap with every other group by joining the matrix with itself on the
   token: a pair of groups whose unions share fewer than ``k`` deciding tokens, or whose sizes are too
   far apart, holds no link, and neither does a group in which no member shares as many with another;
4. opens only the qualifying pairs of groups: first by parity sketches of the sets (a quarter byte a gram), whose
   differing bits are at most the differing grams, then, for members that still may have a partner there, by
   exact intersections.

The common order ranks grams by a fixed-size table of counters over all documents, so passages that
many documents share come last and decide nothing unless a document consists of little else. The order
decides only how much work is done; every link is found whatever the order.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import textbytes as tb
from cadenza.llm.components import components
from cadenza.llm.workspace import Workspace

#: Counters of the common order: 2 MB once their values are ranks of a byte; the size never changes.
COUNTERS = 1 << 21
#: One row of the partial counters.
CHUNK = 1 << 16
#: Tokens that two groups must share, where the sets are large enough.
SHARED = 3
#: Grams and members of a block of a large group.
BLOCK_TOKENS, BLOCK_SETS = 1 << 16, 1 << 10
#: Blocks of a large group up to which all their pairs are opened at once; pairs of larger families wait (see ``_edges``).
FAMILY_BLOCKS = 16
#: Opened sets are marked in a broadcast table of 256 chunks of so many bits (8 MB, whatever the input), so that most others
#: stay out of the shuffle; what a shared bit lets through, the join on the key drops.
MARK_BITS = 1 << 18
#: Members times grams of a block pair up to which intersections are one matrix product.
DENSE = 1 << 24


def document_sets(column: pa.Array, n: int):
    """For each text of the batch its sorted distinct gram hashes (uint64); a null or wordless text has none."""
    data, offsets = tb.utf8(column)
    for first, last, part, at in tb.runs(data, offsets):
        part = tb.lowered(part)
        start, end, of = tb.word_spans(part, at, tb.NON_SPACE)
        words = tb.span_hashes(part, start, end)
        grams = tb.ngram_hashes(words, n)
        for i in range(last - first):
            a, b = int(of[i]), int(of[i + 1])
            if b - a >= n:
                yield first + i, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield first + i, tb.ngram_hashes(words[a:b], b - a)
            else:
                yield first + i, np.zeros(0, dtype=np.uint64)


def set_key(grams: np.ndarray) -> bytes | None:
    """16 bytes that name the set; None for the empty one."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _mark(key: bytes) -> int:
    """The key's bit in the table of opened sets."""
    return key[0] * MARK_BITS + int.from_bytes(key[1:4], "little") % MARK_BITS


def group_key(grams: np.ndarray, rank: np.ndarray) -> int:
    """The least hash, under an order of its own, of the grams of at least median rank: similar sets mostly agree in it."""
    own = rank[_slot(grams)]
    return int(tb.mix(grams[own >= np.median(own)], 77).min().view(np.int64))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams & tb.U64(COUNTERS - 1)).astype(np.int64)


def parity_sketch(grams: np.ndarray) -> bytes:
    """A power of two of bits, at least twice the set's grams and 64: each the parity of the grams hashed to it."""
    bits = max(64, 1 << int(2 * len(grams) - 1).bit_length())
    slot = (tb.mix(grams, 9) & tb.U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=bits) & 1).tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: parities of grams that now share a bit add up."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _least_overlap(n: int, num: int, den: int) -> int:
    """The least intersection of a set of n grams with any set it links to: ceil(threshold * n)."""
    return -(-num * n // den)


def _ordered(grams: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The deciding grams: the first ones in the common order."""
    least = _least_overlap(len(grams), num, den)
    keep = len(grams) - least + min(SHARED, least)
    return grams[np.lexsort((grams, rank[_slot(grams)]))[:keep]]


class JaccardJoin:
    """All links of ``docs`` at a Jaccard similarity of at least ``threshold`` over ``n``-word shingles.

    docs: a DataFrame with an id column of an ordered type and a text column (names are parameters; more columns are
    ignored). Null, empty and wordless texts have the empty set and no link. Rows that repeat an id or a
    text are members of one class per distinct set.

    classes(): one row per distinct set (key, n, rep = smallest id, copies).
    links(): (a, b) keys of linked classes; with ``forest`` only enough of them to connect every component,
        without it every link between different sets with its intersection and similarity.
    members(): per row of docs: id, n_shingles, key.
    labelled(): per row of docs: id, n_shingles, component_id (smallest id reachable, itself included).
    """

    def __init__(self, docs: DataFrame, n: int = 5, threshold: float | Fraction = Fraction(4, 5), doc_id: str = "doc_id", text: str = "text"):
        share = Fraction(threshold).limit_denominator(1000)
        if not 0 < share <= 1 or n < 1:
            raise ValueError("threshold lies in (0, 1] and n is at least 1")
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, share.numerator, share.denominator
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.ws = Workspace(self.spark, "jaccard")
        self._first = self._scan()

    def _scan(self) -> DataFrame:
        """One pass over the texts: a row per document, and the task's counters in rows of their own."""
        n = self.n

        def scan(batches):
            counts, kind = np.zeros(COUNTERS, dtype=np.uint32), None
            for batch in batches:
                kind, size, key = batch.schema.field(0).type, [], []
                for _, grams in document_sets(batch.column(1), n):
                    counts[_slot(grams)] += 1
                    size.append(len(grams))
                    key.append(set_key(grams))
                rows = len(size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], ["doc_id", "n", "key", "chunk", "counts"])
            chunks = [k for k in range(COUNTERS // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
            if chunks:
                held = [counts[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in chunks]
                void = len(chunks)
                yield pa.RecordBatch.from_arrays([pa.nulls(void, kind), pa.nulls(void, pa.int64()), pa.nulls(void, pa.binary()), pa.array(chunks, pa.int32()), pa.array(held, pa.binary())], ["doc_id", "n", "key", "chunk", "counts"])

        return self.ws.table("scan", self.docs.mapInArrow(scan, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, n long, key binary, chunk int, counts binary"))

    def members(self) -> DataFrame:
        return self._first.where("chunk IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "key")

    def classes(self) -> DataFrame:
        if not hasattr(self, "_classes"):
            rows = self._first.where("chunk IS NULL AND key IS NOT NULL")
            self._classes = self.ws.table("classes", rows.groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        return self._classes

    def _rank(self):
        """Broadcast of the common order's ranks: COUNTERS bytes, whatever the input."""

        def total(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = np.frombuffer(held.as_buffer(), dtype=np.uint32).astype(np.uint64)
                    sums[k] = sums[k] + part if k in sums else part
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(np.floor(np.log2(np.maximum(s, 1)) * 4), 255).astype(np.uint8).tobytes() for s in sums.values()], pa.binary())], ["chunk", "rank"])

        parts = self._first.where("chunk IS NOT NULL").select("chunk", "counts").repartition(COUNTERS // CHUNK, "chunk").mapInArrow(total, "chunk int, rank binary")
        rank = np.zeros(COUNTERS, dtype=np.uint8)
        for r in parts.collect():  # COUNTERS bytes in all
            rank[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.rank, dtype=np.uint8)
        return self.spark.sparkContext.broadcast(rank)

    def _deciding(self) -> DataFrame:
        """(key, n, g, sketch, tokens): group key, sketch and deciding grams of every class; copies read by other tasks may repeat it."""
        n, num, den, rank = self.n, self.num, self.den, self._rank()

        def deciding(batches):
            seen: set[bytes] = set()
            order = rank.value
            for batch in batches:
                keys, group, full, sketch, tokens, sizes = [], [], [], [], [], [0]
                for _, grams in document_sets(batch.column(0), n):
                    key = set_key(grams)
                    if key is None or key in seen:
                        continue
                    if len(seen) >= 200_000:  # repeats beyond this only cost rows that the union drops
                        seen.clear()
                    seen.add(key)
                    first = _ordered(grams, order, num, den)
                    keys.append(key)
                    group.append(group_key(grams, order))
                    full.append(len(grams))
                    sketch.append(parity_sketch(grams))
                    tokens.append(first)
                    sizes.append(sizes[-1] + len(first))
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(full, pa.int64()), pa.array(group, pa.int64()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["key", "n", "g", "sketch", "tokens"])

        return self.ws.table("deciding", self.docs.select("text").mapInArrow(deciding, "key binary, n long, g long, sketch binary, tokens array<long>"))

    def _pairs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The deciding grams, blocks(key, b, wide: of a group of more than FAMILY_BLOCKS blocks) and opened(b1, b2): the pairs of blocks, and blocks alone, that the bounds leave."""
        d = self._deciding()
        c = d.groupBy("key").agg(F.first("n").alias("n"), F.first("g").alias("g"))
        wide = c.groupBy("g").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_TOKENS), F.count("*") / F.lit(BLOCK_SETS))).alias("cuts")).where("cuts > 1")
        wide = self.ws.table("wide", wide)  # few rows; written, so that Spark knows whether they may be broadcast
        placed = c.join(wide, "g", "left").withColumn("b", F.xxhash64("g", F.pmod(F.xxhash64("key"), F.coalesce("cuts", F.lit(1)))))
        blocked = self.ws.table("blocks", placed.select("key", "b", F.coalesce(F.col("cuts") > FAMILY_BLOCKS, F.lit(False)).alias("wide")))
        cells = d.join(blocked.drop("wide"), "key").select(F.explode("tokens").alias("token"), "b", "n", F.xxhash64("key").alias("k"))
        cells = cells.repartition(F.col("token")).groupBy("token", "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), (F.min("k") != F.max("k")).alias("several"))
        among = Window.partitionBy("token")
        m = self.ws.table("matrix", cells.withColumn("groups", F.count(F.lit(1)).over(among)).where("groups > 1 OR several"))
        fits = f"x.hi * {self.den} >= y.lo * {self.num} AND y.hi * {self.den} >= x.lo * {self.num}"
        bound = m.alias("x").join(m.alias("y"), F.expr(f"x.token = y.token AND x.b < y.b AND {fits}")).groupBy(F.col("x.b").alias("b1"), F.col("y.b").alias("b2")).agg(F.count("*").alias("shared"), F.min(F.least("x.lo", "y.lo")).alias("lo"))
        own = m.where("several").groupBy(F.col("b").alias("b1"), F.col("b").alias("b2")).agg(F.count("*").alias("shared"), F.min("lo").alias("lo"))
        pairs = bound.unionByName(own).where(f"shared >= least({SHARED}, ceil({self.num} * lo / {self.den}))")
        return d, blocked, pairs.select("b1", "b2")

    def _flagged(self, d: DataFrame, blocked: DataFrame, opened: DataFrame, name: str) -> DataFrame:
        """(b1, b2, key, b): the members to verify of the opened pairs, by their sketches."""
        sides = opened.select("b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("b"))
        members = blocked.drop("wide").join(sides, "b")
        num, den = self.num, self.den

        def flag(table: pa.Table) -> pa.Table:
            left, right = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
            known: dict[bytes, tuple[int, int, np.ndarray]] = {}
            for key, b, n, sketch in zip(table.column("key").to_pylist(), table.column("b").to_pylist(), table.column("n").to_pylist(), table.column("sketch"), strict=True):
                if key not in known:
                    known[key] = (b, n, np.frombuffer(sketch.as_buffer(), dtype=np.uint64))
            keys = sorted(known)
            kept = _maybe_linked([known[k] for k in keys], left == right, num, den)
            kept = [keys[i] for i in kept]
            size = len(kept)
            return pa.table({"b1": pa.array([left] * size, pa.int64()), "b2": pa.array([right] * size, pa.int64()), "key": pa.array(kept, pa.binary()), "b": pa.array([known[k][0] for k in kept], pa.int64())})

        looked = d.select("key", "n", "sketch").join(members, "key").groupBy("b1", "b2").applyInArrow(flag, "b1 long, b2 long, key binary, b long")
        return self.ws.table(name, looked)

    def _marks(self, flagged: DataFrame):
        """Broadcast of the bit table of the opened keys."""

        def mark(batches):
            chunks: dict[int, np.ndarray] = {}
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    bits = chunks.setdefault(key[0], np.zeros(MARK_BITS // 8, dtype=np.uint8))
                    at = _mark(key) % MARK_BITS
                    bits[at >> 3] |= 1 << (at & 7)
            yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["chunk", "bits"])

        parts = flagged.select("key").distinct().repartition(32, F.substring("key", 1, 1)).mapInArrow(mark, "chunk int, bits binary")
        table = np.zeros(256 * MARK_BITS // 8, dtype=np.uint8)
        for r in parts.collect():  # the size of the table in all
            table[r.chunk * MARK_BITS // 8 : (r.chunk + 1) * MARK_BITS // 8] = np.frombuffer(r.bits, dtype=np.uint8)
        return self.spark.sparkContext.broadcast(table.tobytes())

    def links(self) -> DataFrame:
        """(a, b, inter, similarity): keys of linked classes, a < b as bytes."""
        return self._verified(self._flagged(*self._pairs(), "flagged"))

    def _verified(self, flagged: DataFrame, forest: bool = False) -> DataFrame:
        n, num, den = self.n, self.num, self.den
        marks = self._marks(flagged)

        def sets(batches):
            seen: set[bytes] = set()
            table = marks.value
            for batch in batches:
                keys, grams_ = [], []
                for _, grams in document_sets(batch.column(0), n):
                    key = set_key(grams)
                    if key is None or key in seen or not table[(at := _mark(key)) >> 3] >> (at & 7) & 1:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    grams_.append(grams.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(grams_, pa.binary())], ["key", "grams"])

        rows = self.docs.select("text").mapInArrow(sets, "key binary, grams binary").join(flagged, "key")

        def verify(table: pa.Table) -> pa.Table:
            same = table.column("b1")[0].as_py() == table.column("b2")[0].as_py()
            left = table.column("b1")[0].as_py()
            members: dict[bytes, tuple[int, np.ndarray]] = {}
            for key, b, grams in zip(table.column("key").to_pylist(), table.column("b").to_pylist(), table.column("grams"), strict=True):
                if key not in members:  # several tasks may have read copies of one set
                    members[key] = (b, np.frombuffer(grams.as_buffer(), dtype=np.uint64))
            keys = sorted(members)
            first = [k for k in keys if members[k][0] == left]
            second = first if same else [k for k in keys if members[k][0] != left]
            found = _linked(first, second, {k: v[1] for k, v in members.items()}, same, num, den, forest)
            return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary()), "inter": pa.array([x[2] for x in found], pa.int64()), "similarity": pa.array([x[3] for x in found], pa.float64())})

        return rows.groupBy("b1", "b2").applyInArrow(verify, "a binary, b binary, inter long, similarity double")

    def _edges(self) -> DataFrame:
        """(a, b): links enough to connect every component.

        Pairs of blocks of very large groups, families of near copies mostly, wait: at first only one of each block's pairs
        is opened. Of the others those are opened later whose blocks do not lie in one component by then.
        """
        d, blocked, opened = self._pairs()
        wide = blocked.where("wide").select("b").distinct()
        if wide.isEmpty():
            return self._verified(self._flagged(d, blocked, opened, "flagged"), True).select("a", "b")
        wide = self.ws.table("wide-blocks", wide)
        one = lambda side: wide.select(F.col("b").alias(side), F.lit(True).alias(f"wide_{side}"))
        marked = opened.join(one("b1"), "b1", "left").join(one("b2"), "b2", "left").withColumn("family", F.expr("b1 <> b2 AND wide_b1 AND wide_b2")).select("b1", "b2", F.coalesce("family", F.lit(False)).alias("family"))
        marked = self.ws.table("marked", marked)
        star = marked.where("family").groupBy("b2").agg(F.min("b1").alias("b1"))
        now = marked.where("NOT family").select("b1", "b2").unionByName(star.select("b1", "b2"))
        edges = self.ws.table("links-1", self._verified(self._flagged(d, blocked, now, "flagged-1"), True).select("a", "b"))
        later = self.ws.table("later", marked.where("family").select("b1", "b2").join(star, ["b1", "b2"], "left_anti"))
        if later.isEmpty():
            return edges
        roots = components(edges, self.ws, "cc-first").withColumnRenamed("node", "key")
        lie = blocked.where("wide").join(roots, "key", "left").select("b", F.coalesce("root", "key").alias("root"))
        whole = lie.groupBy("b").agg(F.min("root").alias("root"), F.max("root").alias("last")).where("root = last").select("b", "root")
        tied = later.join(whole.select(F.col("b").alias("b1"), F.col("root").alias("r1")), "b1").join(whole.select(F.col("b").alias("b2"), F.col("root").alias("r2")), "b2").where("r1 = r2")
        left = self.ws.table("left", later.join(tied.select("b1", "b2"), ["b1", "b2"], "left_anti"))
        if left.isEmpty():
            return edges
        more = self._verified(self._flagged(d, blocked, left, "flagged-2"), True)
        return edges.unionByName(self.ws.table("links-2", more.select("a", "b")))

    def labelled(self) -> DataFrame:
        roots = components(self._edges(), self.ws).withColumnRenamed("node", "key")
        self.ws.drop("deciding", "matrix")
        c = self.classes().select("key", "rep")
        tied = roots.join(c, "key")
        least = tied.groupBy("root").agg(F.min("rep").alias("least"))
        named = tied.join(least, "root").select("key", "least")
        final = c.join(named, "key", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
        return self.members().join(final, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _maybe_linked(members, same, num, den) -> list[int]:
    """Places of the (block, n, sketch) that differ from some member across in few enough bits to be linked."""
    block = np.array([m[0] for m in members])
    size = np.array([m[1] for m in members], dtype=np.int64)
    words = np.array([len(m[2]) for m in members])
    keep = np.zeros(len(members), dtype=bool)
    for w in np.unique(words):
        large = np.flatnonzero(words >= w)
        folded = np.stack([_folded(members[i][2], w) for i in large])
        for i in np.flatnonzero(words == w):
            across = np.ones(len(large), dtype=bool) if same else block[large] != block[i]
            across &= (large != i) & (size[large] * den >= size[i] * num) & (size[i] * den >= size[large] * num)
            at = np.flatnonzero(across)
            if len(at):
                apart = np.bitwise_count(folded[at] ^ members[i][2]).sum(axis=1, dtype=np.int64)
                hit = large[at[apart * (den + num) <= (size[large[at]] + size[i]) * (den - num)]]
                keep[hit] = True
                keep[i] |= len(hit) > 0
    return np.flatnonzero(keep).tolist()


def _linked(first, second, sets, same, num, den, forest):
    """Exact links between two lists of keys (or within one): (smaller key, larger key, intersection, similarity)."""
    if not first or not second:
        return []
    every = first if same else first + second
    sizes = np.array([len(sets[k]) for k in every], dtype=np.int64)
    flat = np.concatenate([sets[k] for k in every])
    values, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(every)), sizes)
    a, b = np.arange(len(first)), np.arange(len(second)) + (0 if same else len(first))
    inter = np.zeros((len(a), len(b)), dtype=np.int64)
    step = max(1, DENSE // max(1, len(every)))
    for lo in range(0, len(values), step):
        inside = (code >= lo) & (code < lo + step)
        hit = np.zeros((len(every), min(step, len(values) - lo)), dtype=np.float32)
        hit[row[inside], code[inside] - lo] = 1
        inter += np.rint(hit[a] @ hit[b].T).astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - inter
    ok = inter * den >= union * num
    if same:
        ok &= np.triu(np.ones_like(ok), 1)
    found, parent = [], {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for i, j in np.argwhere(ok):
        x, y = every[a[i]], every[b[j]]
        if forest:
            p, q = root(x), root(y)
            if p == q:
                continue
            parent[p] = q
        found.append((min(x, y), max(x, y), int(inter[i, j]), float(inter[i, j] / union[i, j])))
    return found
