"""Token counts under a unigram segmentation, by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its runs of non-white-space bytes, each with the word mark before it. The distinct ones
of a batch are put in a trie; the forward score of a prefix (the best sum of piece scores over its segmentations,
fewest pieces among equals) is computed once for all pre-tokens that share it, level by level, and the number of
pieces is stored where a pre-token ends. A byte that no piece covers is a piece of its own at a score below all
others. The trie is as deep as most pre-tokens are long; what a longer one holds beyond that depth goes on alone from
its node's scores, so one very long pre-token costs its own length only. Everything happens in the task that reads the
texts: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textbytes as tb
from cadenza.llm.workspace import ship

#: Distinct pre-tokens a worker remembers; beyond that it starts anew, which changes speed only.
REMEMBERED = 1_000_000
RUN = 4 << 20
#: Levels of the trie.
DEPTH = 256
#: Ends of pieces looked up at once in the rest of a long pre-token.
STRETCH = 1 << 18
MARK = "▁".encode()


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces. Its ranks become Zipf scores, -log(rank + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i).encode(), -float(np.log(rank + 1))) for rank, i in enumerate(kept)]


class TrieCounter:
    def __init__(self, pieces: list[tuple[bytes, float]]):
        flat = np.frombuffer(b"".join(p for p, _ in pieces), dtype=np.uint8)
        end = np.cumsum([len(p) for p, _ in pieces])
        start = end - np.array([len(p) for p, _ in pieces])
        keys = tb.span_hashes(flat, start, end)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array([s for _, s in pieces])[order]
        self.lengths = sorted({len(p) for p, _ in pieces})
        self.single = float(self.scores.min()) - 10.0
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(keys & tb.U64((1 << 20) - 1)).astype(np.int64)] = True
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._flat = None

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each of the given distinct pre-tokens (their bytes, mark included)."""
        order = sorted(range(len(words)), key=words.__getitem__)
        n = len(words)
        size = np.array([len(words[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in order), dtype=np.uint8)
        start = np.cumsum(size) - size
        shared = np.zeros(n, dtype=np.int64)  # bytes in common with the pre-token before
        open_ = np.arange(1, n)
        depth = 0
        while len(open_) and depth < DEPTH:
            open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
            open_ = open_[flat[start[open_] + depth] == flat[start[open_ - 1] + depth]]
            depth += 1
            shared[open_] = depth
        longest = min(DEPTH, int(size.max())) if n else 0
        keep = self.lengths[-1] + 1
        score = {0: np.zeros(n)}
        pieces = {0: np.zeros(n, dtype=np.int64)}
        result = np.zeros(n, dtype=np.int64)
        for d in range(1, longest + 1):
            alive = np.flatnonzero(size >= d)
            new = shared[alive] < d
            head = alive[new]  # one pre-token for each node of this level
            best, least = score[d - 1][head] + self.single, pieces[d - 1][head] + 1
            for m in self.lengths:
                if m > d:
                    break
                keys = self._keys(flat, start[head] + d - m, m)
                maybe = np.flatnonzero(self.filter[(keys & tb.U64((1 << 20) - 1)).astype(np.int64)])
                if not len(maybe):
                    continue
                at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
                ok = self.keys[at] == keys[maybe]
                i, s = maybe[ok], self.scores[at[ok]]
                total, used = score[d - m][head[i]] + s, pieces[d - m][head[i]] + 1
                better = (total > best[i]) | ((total == best[i]) & (used < least[i]))
                best[i[better]], least[i[better]] = total[better], used[better]
            node = np.cumsum(new) - 1
            full, made = np.zeros(n), np.zeros(n, dtype=np.int64)
            full[alive], made[alive] = best[node], least[node]
            score[d], pieces[d] = full, made
            score.pop(d - keep, None), pieces.pop(d - keep, None)
            done = alive[size[alive] == d]
            result[done] = made[done]
        for i in np.flatnonzero(size > DEPTH).tolist():
            result[i] = self._rest(flat, int(start[i]), int(size[i]), [(float(score[d][i]), int(pieces[d][i])) for d in range(max(0, DEPTH - keep + 1), DEPTH + 1)])
        out = np.zeros(n, dtype=np.int64)
        out[order] = result
        self._flat = self._sums = self._inverse = None  # as large as the pre-tokens; the counter outlives them
        return out

    def _rest(self, flat: np.ndarray, start: int, size: int, last: list[tuple[float, int]]) -> int:
        """Pieces of a pre-token longer than the trie is deep, from (score, pieces) of its last prefixes in the trie."""
        for lo in range(DEPTH + 1, size + 1, STRETCH):
            ends = np.arange(lo, min(lo + STRETCH, size + 1))
            found = []  # (end, length, score) of every piece that ends in the stretch
            for m in self.lengths:
                at = ends[ends >= m]
                keys = self._keys(flat, start + at - m, m)
                maybe = np.flatnonzero(self.filter[(keys & tb.U64((1 << 20) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
                ok = self.keys[place] == keys[maybe]
                found.append((at[maybe[ok]], np.full(int(ok.sum()), m), self.scores[place[ok]]))
            end, m, gain = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(end, kind="stable")
            first = np.searchsorted(end[order], np.arange(lo, ends[-1] + 2)).tolist()
            m, gain = m[order].tolist(), gain[order].tolist()
            for k in range(len(ends)):
                best, least = last[-1][0] + self.single, last[-1][1] + 1
                for j in range(first[k], first[k + 1]):
                    total, used = last[-m[j]][0] + gain[j], last[-m[j]][1] + 1
                    if total > best or total == best and used < least:
                        best, least = total, used
                last.append((best, least))
            del last[: -self.lengths[-1] - 1]
        return last[-1][1]

    def _keys(self, flat: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the m bytes from each place."""
        if self._flat is not flat:
            self._flat = flat
            self._sums = tb.prefix_sums(flat)
            self._inverse = tb.powers(len(flat) + 1, tb._BASE_INV)
        h = (self._sums[at + m] - self._sums[at]) * self._inverse[at]
        return tb.mix(h + tb.U64((m * 0xA24BAED4963EE407) & (2**64 - 1)))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        start, end, of = tb.word_spans(data, offsets, tb.NON_SPACE)
        keys, one, back = np.unique(tb.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > REMEMBERED:
            self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            counts = self.count([MARK + raw[start[i] : end[i]] for i in one[new]])
            known, counts = np.concatenate([self.known, keys[new]]), np.concatenate([self.counts, counts])
            order = np.argsort(known)
            self.known, self.counts = known[order], counts[order]
        upto = np.concatenate([[0], np.cumsum(self.counts[np.searchsorted(self.known, keys)][back])]) if len(keys) else np.zeros(1, np.int64)
        return np.diff(of), upto[of[1:]] - upto[of[:-1]]


def _counter(model: str) -> TrieCounter:
    return TrieCounter(vocabulary(model))


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, n_words (pre-tokens) and n_tokens of every row.

    Null, empty and blank texts have none; long texts and pre-tokens are counted whole; repeated rows are counted each;
    equally good segmentations count as the one of fewest pieces; other columns of any name are ignored. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)

    def run(batches):
        counter = tb.kept(_counter, model)  # pre-tokens that earlier tasks met are known
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, part, at in tb.runs(data, offsets, RUN):
                w, t = counter.texts(part, at)
                words.append(w)
                tokens.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(name) for name in keep), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())], ["doc_id", *keep, "n_words", "n_tokens"])

    return rows.mapInArrow(tb.tidied(run), T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens")]))
