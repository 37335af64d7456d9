"""Benchmark decontamination by winnowing.

A fingerprint of a text is the least hash of each run of ``span - k + 1`` consecutive word k-grams (the
rightmost one among equal hashes). Two texts that share ``span`` words share such a run, so they select the
same k-gram of it: joining document fingerprints with item fingerprints meets every shared span. Each meeting
is extended to the span's words, which must be equal, so a hit is exact up to 64-bit word hashes.

The benchmark's distinct texts are cut into blocks of bounded size. A block's fingerprints are broadcast and joined
inside the task that reads the documents, so documents are not shuffled. A benchmark of several blocks is as many
passes, one block at a time: documents are written once with row ids, a pass leaves a row for each document that it
hits, and those rows are merged and joined with the documents at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textbytes as tb
from cadenza.llm.columns import unused
from cadenza.llm.workspace import Workspace, ship

#: UTF-8 bytes of item texts in a block that is broadcast.
BLOCK_BYTES = 16 << 20
RESULT = {
    "n_words": T.LongType(),
    "n_hit": T.LongType(),
    "hit_items": T.ArrayType(T.StringType()),
    "hit_spans": T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])),
}


def select_fingerprints(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Positions of the fingerprints: of every run of ``width`` hashes inside [lo, hi) the rightmost least one."""
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    inside = np.zeros(len(windows) + 1, dtype=np.int64)
    ok = hi - lo >= width
    np.add.at(inside, lo[ok], 1)
    np.add.at(inside, hi[ok] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return at
    least = width - 1 - np.argmin(windows[at][:, ::-1], axis=1)
    return np.unique(at + least)


class ItemIndex:
    """The fingerprints of a block of items, sorted for the join."""

    def __init__(self, ids: list[list[str]], texts: list[str], span: int, k: int):
        """``ids``: the names of the items that have each text."""
        self.span, self.k = span, k
        data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
        data = tb.lowered(data)
        start, end, of = tb.word_spans(data, offsets, tb.ALNUM)
        words = tb.span_hashes(data, start, end)
        classes: dict[bytes, int] = {}
        self.ids: list[set[str]] = []
        kept: list[np.ndarray] = []
        for i, names in enumerate(ids):
            own = words[of[i] : of[i + 1]]
            if not len(own):
                continue
            c = classes.setdefault(own.tobytes(), len(kept))  # items of equal words are one class
            if c == len(kept):
                kept.append(own)
                self.ids.append(set())
            self.ids[c].update(names)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for c, own in enumerate(kept):
            if len(own) < span:
                by_length.setdefault(len(own), []).append(c)
        for length, cs in by_length.items():
            h = np.array([tb.ngram_hashes(kept[c], length)[0] for c in cs], dtype=np.uint64)
            o = np.argsort(h)
            self.short[length] = h[o], np.array(cs, dtype=np.int64)[o]
        long = [c for c, own in enumerate(kept) if len(own) >= span]
        sizes = np.array([len(kept[c]) for c in long], dtype=np.int64)
        flat = np.concatenate([kept[c] for c in long]) if long else np.zeros(0, dtype=np.uint64)
        lo = np.cumsum(sizes) - sizes
        at = select_fingerprints(tb.ngram_hashes(flat, k), lo, lo + sizes - k + 1, span - k + 1)
        item = np.repeat(np.arange(len(long)), sizes)[at] if len(at) else np.zeros(0, np.int64)
        prints = tb.ngram_hashes(flat, k)[at]
        o = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[o], at[o]
        self.item = np.array(long, dtype=np.int64)[item[o]] if len(o) else np.zeros(0, np.int64)
        self.lo = lo[item[o]] if len(o) else np.zeros(0, np.int64)
        self.hi = (lo + sizes)[item[o]] if len(o) else np.zeros(0, np.int64)
        self.spans = tb.ngram_hashes(flat, span)

    def hits(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item class) of every window of an item in the texts whose words are given."""
        found = [self._long(words, of)]
        text = np.repeat(np.arange(len(of) - 1), np.diff(of))
        for length, (hashes, cs) in self.short.items():
            grams = tb.ngram_hashes(words, length)
            lo, hi = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            at = np.flatnonzero(hi > lo)
            at = at[text[at] == text[at + length - 1]]
            n = (hi - lo)[at]
            pick = np.repeat(lo[at], n) + _within(n)
            found.append((np.repeat(at, n), np.full(int(n.sum()), length), cs[pick]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _long(self, words: np.ndarray, of: np.ndarray):
        span, k = self.span, self.k
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.prints) or len(words) < span:
            return none
        grams = tb.ngram_hashes(words, k)
        at = select_fingerprints(grams, of[:-1], of[1:] - k + 1, span - k + 1)
        lo, hi = np.searchsorted(self.prints, grams[at], "left"), np.searchsorted(self.prints, grams[at], "right")
        n = hi - lo
        if not n.any():
            return none
        pos = np.repeat(at, n)
        pick = np.repeat(lo, n) + _within(n)
        text = np.searchsorted(of, pos, "right") - 1
        spans = tb.ngram_hashes(words, span)
        first, item = [], []
        for back in range(span - k + 1):  # the span may start up to so many words before its fingerprint
            p, q = pos - back, self.at[pick] - back
            ok = (p >= of[text]) & (p + span <= of[text + 1]) & (q >= self.lo[pick]) & (q + span <= self.hi[pick])
            p, q, c = p[ok], q[ok], self.item[pick][ok]
            same = spans[p] == self.spans[q]
            first.append(p[same])
            item.append(c[same])
        first, item = np.concatenate(first), np.concatenate(item)
        return first, np.full(len(first), span), item


def _within(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _batch(column: pa.Array, index: ItemIndex) -> tuple[list[int], list[list[str]], list[list[tuple[int, int]]]]:
    """Words, names of items with windows, and hit word ranges of each text."""
    n_words, items, spans = [], [], []
    data, offsets = tb.utf8(column)
    for first, last, part, at in tb.runs(data, offsets):
        part = tb.lowered(part)
        start, end, of = tb.word_spans(part, at, tb.ALNUM)
        pos, length, item = index.hits(tb.span_hashes(part, start, end), of)
        edge = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + length, -1)
        hit = np.cumsum(edge[:-1]) > 0
        text = np.searchsorted(of, pos, "right") - 1
        pairs = np.unique(np.stack([text, item]), axis=1) if len(pos) else np.zeros((2, 0), np.int64)
        named: dict[int, set[str]] = {}
        for t, c in pairs.T.tolist():
            named.setdefault(t, set()).update(index.ids[c])
        for i in range(last - first):
            a, b = int(of[i]), int(of[i + 1])
            n_words.append(b - a)
            items.append(sorted(named.get(i, ())))
            if i in named:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                spans.append([(int(x), int(y) - 1) for x, y in zip(turn[::2], turn[1::2], strict=True)])
            else:
                spans.append([])
    return n_words, items, spans


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _results(words, names, ranges) -> list[pa.Array]:
    """The columns of RESULT."""
    hit = [sum(b - a + 1 for a, b in r) for r in ranges]
    spans = pa.array([[{"first": a, "last": b} for a, b in r] for r in ranges], _SPANS)
    return [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), spans]


def _joined_in_scan(docs: DataFrame, items: DataFrame, text: str, span: int, k: int) -> DataFrame:
    """``docs`` with RESULT from the items of one block."""
    own = items.collect()  # about a block's bytes
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r.names for r in own], [r.text for r in own], span, k))
    where = docs.schema.fieldNames().index(text)

    def judge(batches):
        for batch in batches:
            found = _batch(batch.column(where).cast(pa.large_string()), index.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_results(*found)], [*batch.schema.names, *RESULT])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in RESULT.items())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit (words inside any window of an item), hit_items (names of those
    items, each once, sorted as strings) and hit_spans (first and last word of each hit range, from 0).

    A window is ``span`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and wordless texts, of documents or items, have no words and no hits; items without an id are matched
    but not named, and repeated item rows count once. Repeated documents are judged one by one, long texts whole;
    items of equal words all count. Columns of ``docs`` with the names of results are replaced. An empty benchmark
    gives zeros, an empty table of documents no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    items = items.groupBy("text").agg(F.collect_set("name").alias("names"))  # without null names
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    base = docs.drop(*RESULT)
    if blocks == 1:
        return _joined_in_scan(base, items, text, span, k)
    ws = Workspace(spark, "decontaminate")
    (row,) = unused(base, "row")
    numbered = ws.table("documents", base.withColumn(row, F.monotonically_increasing_id()))
    narrow = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("text"))
    items, hits, words = ws.table("items", items), None, None
    for block in range(blocks):
        one = _joined_in_scan(narrow, items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block), "text", span, k)
        one = ws.table(f"hits-{block}", one.where("n_hit > 0" if block else "true").select("row", "n_words", "hit_items", "hit_spans"))  # the first has every document's words
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("items"), F.flatten(F.collect_list("hit_spans")).alias("spans"))  # of one document

    def sums(batches):
        for batch in batches:
            ranges = [_merged([(s["first"], s["last"]) for s in r]) for r in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *_results(batch.column("n_words").to_pylist(), batch.column("items").to_pylist(), ranges)], ["row", *RESULT])

    found = merged.mapInArrow(sums, T.StructType([T.StructField("row", T.LongType()), *(T.StructField(c, t) for c, t in RESULT.items())])).withColumnRenamed("row", row)
    return numbered.join(found, row).select(*(f"`{c}`" for c in base.columns), *RESULT)
