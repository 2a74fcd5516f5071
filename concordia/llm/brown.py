"""LM scoring with Brown class-based bigrams.

p(w | v) = p(c(w) | c(v)) p(w | c(w)), classes by exchange clustering.

Texts are tokenized once into chunks: a chunk holds some documents, its distinct words' 64-bit hashes, and the
tokens as indices into them.  From then on, everything is arrays of integers, and what has to meet across
chunks (a word's count, its class, its neighbours' classes) is dealt out by word hash in packed pieces,
once per chunk and distinct word, so that the most common word is no larger a key than any other.
No vocabulary is ever broadcast; what travels to all tasks is the class matrix and the classes of at most
``frequent`` words.

Clustering: the ``frequent`` commonest words of the training texts exchange classes in passes over all training
tokens.  The commonest words start as classes of their own (as in Brown et al. 1992); each pass counts
every word's neighbours' classes over the corpus, and then moves word after word to the class that gains most
log-likelihood (Kneser and Ney 1993), each move seen by the words after it; a pass that loses
likelihood ends the exchange with the classes before it.  All other words of the training texts then choose a
class from all their occurrences, and exchange in ``rest_passes`` further passes dealt over all shards: each sees the
classes of all its neighbours, rare ones included, and moves by the same gain, against the class matrix of the pass's
start without its own counts.  A pass that loses likelihood is taken back.

Smoothing: class transitions are shrunk to class frequencies; a word not seen in training is a class by itself,
whose probability after a class is the Good-Turing share of words seen once there.  Over the training
words and one unseen word, probabilities sum to 1.

Defined results: a null or empty text is one end token; a null id is in training; repeated rows count each time;
without training texts the score is the base score; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import release, ship, stage

CLASSES, FREQUENT, PASSES, REST_PASSES = 64, 1 << 14, 5, 1
CHUNK_TOKENS = 2_000_000
#: Chunks that one task of a counting pass takes: it returns no more cells than a class matrix of FREQUENT words has.
TASK_CHUNKS = 10
SHARD_ENTRIES = 2_000_000
SHARD = "shard long, kind int, chunk long, h binary, x binary, y binary"
SHARD_NAMES = ["shard", "kind", "chunk", "h", "x", "y"]
CHUNK = "chunk long, doc_id array<long>, held binary, lens binary, ids binary, vocab binary, count binary"


def squeezed(ids: np.ndarray) -> bytes:
    """Token indices, compressed: most are small."""
    raw = ids.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def squeezed64(n: np.ndarray) -> bytes:
    """Counts, as 32-bit numbers where they fit."""
    fits = not len(n) or n.max() < 1 << 31
    return b"\4" + n.astype("<i4").tobytes() if fits else b"\10" + n.astype("<i8").tobytes()


def unsqueezed64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], "<i4" if blob[0] == 4 else "<i8").astype(np.int64)


def unsqueezed(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint32)


def chunks_of(docs: DataFrame, folds: int, fold: int, size: int = CHUNK_TOKENS) -> DataFrame:
    """Tokenized chunks; ``count`` has each word's occurrences in training documents."""
    ticket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    src = docs.select(F.col("doc_id").cast("long"), (ticket % folds == fold).alias("held"), F.col("text").cast("binary").alias("text"))
    names = ["chunk", "doc_id", "held", "lens", "ids", "vocab", "count"]

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        index: dict[bytes, int] = {}
        docs_, held, lens, ids = [], [], [], []
        total = 0

        def chunk():
            nonlocal made, total
            made += 1
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            h, l = np.array(held, np.uint8), np.array(lens, np.int64)
            train = np.repeat(h == 0, l)
            count = np.bincount(flat[train], minlength=len(index)).astype(np.int64)
            vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
            row = [[base + made], [list(docs_)], [h.tobytes()], [l.tobytes()], [squeezed(flat)], [vocab.tobytes()], [count.astype(np.int32).tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)
            index.clear()
            for x in (docs_, held, lens, ids):
                x.clear()
            total = 0
            return out

        for batch in batches:
            for doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = (text or b"").lower().split()
                for w in set(words).difference(index):
                    index[w] = len(index)
                docs_.append(doc)
                held.append(out)
                lens.append(len(words))
                ids.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                total += len(words) + 1
                if total >= size:
                    yield chunk()
        if docs_:
            yield chunk()

    return src.mapInArrow(run, CHUNK)


def shards_of(h: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Places of *h* by shard (top bits of the hash; *shards* is a power of two)."""
    bits = shards.bit_length() - 1
    top = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    order = np.argsort(top, kind="stable")
    cuts = np.searchsorted(top[order], np.arange(shards + 1))
    return [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], SHARD_NAMES)


def _array(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_py() if hasattr(cell, "as_py") else cell, kind)


def word_counts(chunks: DataFrame, shards: int) -> DataFrame:
    """Training counts by shard: one row (kind 0) with sorted hashes h and counts x."""

    def give(batches):
        for batch in batches:
            for v, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(v, np.uint64), np.frombuffer(c, np.int32)
                h, n = h[n > 0], n[n > 0]
                yield packed_rows([(s, 0, 0, h[at].tobytes(), n[at].tobytes(), None) for s, at in shards_of(h, shards)])

    def take(table: pa.Table) -> pa.Table:
        h = np.concatenate([_array(x, np.uint64) for x in table.column("h")])
        n = np.concatenate([_array(x, np.int32) for x in table.column("x")]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        row = (table.column("shard")[0].as_py(), 0, 0, h[first].tobytes(), np.add.reduceat(n, first).tobytes(), None)
        return pa.Table.from_batches([packed_rows([row])])

    return chunks.select("vocab", "count").mapInArrow(give, SHARD).groupBy("shard").applyInArrow(take, SHARD)


def sequences(held: np.ndarray, lens: np.ndarray, c: np.ndarray, start: int, end: int):
    """History and target classes of every token with its end tokens, and the document of each."""
    ends = np.cumsum(lens)
    return np.insert(c, ends - lens, start), np.insert(c, ends, end), np.repeat(np.arange(len(lens)), lens + 1)


def neighbour_counts(chunks: DataFrame, rows_: int, words: np.ndarray, classes: np.ndarray, k: int, parts: int) -> DataFrame:
    """One pass over the training tokens.  kind 0: counts of word x neighbour class for each part of *words* (x left,
    y right neighbours); kind 1: the class matrix."""
    rare, start, end, wide = k, k + 1, k + 2, k + 3
    order = np.argsort(words)
    by_hash, place = words[order], order

    def run(batches):
        m = len(words)
        left, right = np.zeros(m * wide, np.int64), np.zeros(m * wide, np.int64)
        matrix = np.zeros(wide * wide, np.int64)
        used = False
        for batch in batches:
            for held, lens, ids, vocab in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                used = True
                held, lens, ids, vocab = np.frombuffer(held, np.uint8), np.frombuffer(lens, np.int64), unsqueezed(ids), np.frombuffer(vocab, np.uint64)
                at = np.searchsorted(by_hash, vocab)
                at[at == m] = 0
                known = by_hash[at] == vocab if m else np.zeros(len(vocab), bool)
                f = np.where(known, place[at], -1) if m else np.full(len(vocab), -1)
                c = np.where(f >= 0, classes[np.maximum(f, 0)], rare)[ids]
                hist, tgt, owner = sequences(held, lens, c, start, end)
                train = held[owner] == 0
                matrix += np.bincount(hist[train] * wide + tgt[train], minlength=wide * wide)
                # a token's left neighbour is its history; its right one is the target after it
                f_tok = f[ids]
                inner = tgt != end
                prev, nxt = hist[inner], np.r_[tgt[1:], end][inner]
                ok = (f_tok >= 0) & train[inner]
                left += np.bincount(f_tok[ok] * wide + prev[ok], minlength=m * wide)
                right += np.bincount(f_tok[ok] * wide + nxt[ok], minlength=m * wide)
        if used:
            each = -(-m // parts) * wide
            rows = [(0, 1, 0, None, matrix.tobytes(), None)]
            for p in range(parts):
                a, b = p * each, min((p + 1) * each, m * wide)
                l, r = left[a:b], right[a:b]
                cells = np.flatnonzero(l | r)
                if len(cells):
                    kind = np.int32 if max(l.max(), r.max()) < 1 << 31 else np.int64
                    rows.append((p, 0, np.dtype(kind).itemsize, cells.astype(np.int32).tobytes(), l[cells].astype(kind).tobytes(), r[cells].astype(kind).tobytes()))
            yield packed_rows(rows)

    each = -(-len(words) // parts) * wide if len(words) else 1

    def add(table: pa.Table) -> pa.Table:
        p, what = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        if what:
            total = sum(_array(x, np.int64) for x in table.column("x"))
            return pa.Table.from_batches([packed_rows([(p, 1, 0, None, total.tobytes(), None)])])
        left, right = np.zeros(each, np.int64), np.zeros(each, np.int64)
        for size, h, x, y in zip(table.column("chunk").to_pylist(), *(table.column(j) for j in ("h", "x", "y")), strict=True):
            cells, kind = _array(h, np.int32), np.int32 if size == 4 else np.int64
            left[cells] += _array(x, kind)
            right[cells] += _array(y, kind)
        return pa.Table.from_batches([packed_rows([(p, 0, 0, None, left.tobytes(), right.tobytes())])])

    tasks = max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-rows_ // TASK_CHUNKS))
    found = chunks.select("held", "lens", "ids", "vocab").coalesce(tasks).mapInArrow(run, SHARD)
    return found.groupBy("shard", "kind").applyInArrow(add, SHARD)


def likelihood(n: np.ndarray) -> float:
    """Class part of the training log-likelihood: sum n log n over cells less that over both margins."""
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return f(n.astype(float).ravel()) - f(n.sum(0).astype(float)) - f(n.sum(1).astype(float))


def class_logs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For moving a word into class b: log p(next | b) by [next, b], and log p(b | prev) / N(b) by [prev, b]."""
    x = n + 0.5
    right = np.log(x / x.sum(1, keepdims=True)).T
    left = np.log(x / x.sum(0, keepdims=True))
    return right, left


def exchange_pass(left: np.ndarray, right: np.ndarray, own: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Classes after every word in turn has moved to the class below *k* that gains most log-likelihood.

    Rows of *left* and *right* are a word's counts by its neighbours' classes as they were before the pass; *n* is the
    class matrix, kept up to date with every move.  Counts of a word beside itself are taken as its class's.
    """
    g = lambda x: x * np.log(np.maximum(x, 1.0))
    n, own = n.astype(float), own.copy()
    for i in range(len(own)):
        a, l, r = own[i], left[i], right[i]
        at_l, at_r = np.flatnonzero(l), np.flatnonzero(r)
        n[a, at_r] = np.maximum(n[a, at_r] - r[at_r], 0.0)
        n[at_l, a] = np.maximum(n[at_l, a] - l[at_l], 0.0)
        after, before = n[:k, at_r], n[at_l, :k]
        gain = (g(after + r[at_r]) - g(after)).sum(1) + (g(before + l[at_l][:, None]) - g(before)).sum(0)
        rows, cols = n[:k].sum(1), n[:, :k].sum(0)
        b = int((gain - g(rows + r.sum()) + g(rows) - g(cols + l.sum()) + g(cols)).argmax())
        n[b, at_r] += r[at_r]
        n[at_l, b] += l[at_l]
        own[i] = b
    return own


def exchange(chunks: DataFrame, words: np.ndarray, k: int, passes: int, rows: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Classes of *words* (commonest first) and the class matrix that goes with them."""
    m, wide = len(words), k + 3
    parts = max(1, m // 2048)
    each = -(-m // parts) if m else 1
    classes = np.where(np.arange(m) < k, np.arange(m), k).astype(np.int64)
    best = None
    for turn in range(passes + 1):
        counts = stage(neighbour_counts(chunks, rows, words, classes, k, parts), f"exchange-{turn}")
        matrix = sum((np.frombuffer(r["x"], np.int64) for r in counts.where("kind = 1").select("x").toLocalIterator()), np.zeros(wide * wide, np.int64)).reshape(wide, wide)
        settled = bool((classes < k).all())
        value = likelihood(matrix)
        if settled and best is not None and value <= best[0]:
            break
        if settled:
            best = (value, classes, matrix)
        if turn == passes and best is not None:
            break

        moved = counts.where("kind = 0").groupBy("kind").applyInArrow(_mover(matrix, classes, k, each), "f long, c long")
        got = moved.toArrow()  # at most FREQUENT rows
        classes = classes.copy()
        classes[got.column("f").to_numpy()] = got.column("c").to_numpy()
        release(chunks.sparkSession)
    if best is None:
        best = (0.0, np.minimum(classes, k - 1), matrix)
    return best[1], best[2]


def _mover(matrix: np.ndarray, classes: np.ndarray, k: int, each: int):
    """One pass of exchanges in one task: it reads a row of counts by class for each of at most FREQUENT words."""
    wide = k + 3

    def move(table: pa.Table) -> pa.Table:
        left, right = np.zeros((len(classes), wide)), np.zeros((len(classes), wide))
        for i, p in enumerate(table.column("shard").to_pylist()):
            part = slice(p * each, min((p + 1) * each, len(classes)))
            size = (part.stop - part.start) * wide
            for side, x in ((left, "x"), (right, "y")):
                side[part] = _array(table.column(x)[i], np.int64)[:size].reshape(-1, wide)
        new = exchange_pass(left, right, classes, matrix, k)
        return pa.table({"f": pa.array(np.arange(len(classes)), pa.int64()), "c": pa.array(new, pa.int64())})

    return move


def runs(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of *times*, one after the other."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


BLOCK = 100_000


def neighbour_rows(vocab: np.ndarray, own: np.ndarray, prev: np.ndarray, nxt: np.ndarray, shards: int) -> list[tuple]:
    """For every shard its distinct words once, their numbers of occurrences (x), and those's neighbour classes (y)."""
    order = np.argsort(own, kind="stable")
    own, prev, nxt = own[order], prev[order].astype(np.uint8), nxt[order].astype(np.uint8)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    times = np.diff(np.r_[first, len(own)])
    h = vocab[own[first]]
    rows = []
    for s, at in shards_of(h, shards):
        each = np.repeat(first[at], times[at]) + runs(times[at])
        rows.append((s, 1, 0, h[at].tobytes(), times[at].astype(np.int32).tobytes(), prev[each].tobytes() + nxt[each].tobytes()))
    return rows


def gathered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A shard's words, counts and classes, and its occurrences by word: word, class before, class after."""
    h, n, c = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    own, prev, nxt = [h], [c], [c]
    for i, what in enumerate(table.column("kind").to_pylist()):
        y = table.column("y")[i]
        if what == 0:
            h, n = _array(table.column("h")[i], np.uint64), _array(table.column("x")[i], np.int64)
            c = _array(y, np.uint8) if y.is_valid else c
        else:
            both = _array(y, np.uint8)
            own.append(np.repeat(_array(table.column("h")[i], np.uint64), _array(table.column("x")[i], np.int32)))
            prev.append(both[: len(both) // 2])
            nxt.append(both[len(both) // 2 :])
    own, prev, nxt = np.concatenate(own), np.concatenate(prev), np.concatenate(nxt)
    order = np.argsort(own, kind="stable")
    return h, n, c, own[order], prev[order], nxt[order]


def word_blocks(own: np.ndarray):
    """Whole words of the sorted *own* at a time, about BLOCK occurrences: where each starts, and the block's ends."""
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
        yield starts[a:b], int(starts[a]), int(starts[b]) if b < len(starts) else len(own)
        a = b


def lexicon(chunks: DataFrame, counts: DataFrame, words: np.ndarray, classes: np.ndarray, matrix: np.ndarray, k: int, shards: int) -> DataFrame:
    """Rows of *counts* with a class for every word: y of kind 0."""
    rare, start, end = k, k + 1, k + 2
    order = np.argsort(words)
    by_hash, its_class = words[order], classes[order]
    r, l = (x[:, :k].astype(np.float32) for x in class_logs(matrix.astype(float)))

    def classed(h):
        at = np.searchsorted(by_hash, h)
        at[at == len(by_hash)] = 0
        return np.where(by_hash[at] == h, its_class[at], rare) if len(by_hash) else np.full(len(h), rare)

    def give(batches):
        for batch in batches:
            for held, lens, ids, vocab in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                held, lens, ids, vocab = np.frombuffer(held, np.uint8), np.frombuffer(lens, np.int64), unsqueezed(ids), np.frombuffer(vocab, np.uint64)
                c = classed(vocab)[ids]
                hist, tgt, owner = sequences(held, lens, c, start, end)
                inner = tgt != end
                prev, nxt = hist[inner], np.r_[tgt[1:], end][inner]
                ok = (c == rare) & (held[owner] == 0)[inner]
                if not ok.any():
                    continue
                rows = neighbour_rows(vocab, ids[ok], prev[ok], nxt[ok], shards)
                yield packed_rows(rows)

    def take(table: pa.Table) -> pa.Table:
        h, n, _, own, prev, nxt = gathered(table)
        c = classed(h)
        for firsts, lo, hi in word_blocks(own):
            score = np.zeros((len(firsts), k), np.float32)
            for x in range(lo, hi, BLOCK):
                y = min(x + BLOCK, hi)
                v = l[prev[x:y]] + r[nxt[x:y]]
                word = np.searchsorted(firsts, np.arange(x, y), side="right") - 1
                cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                score[word[cuts]] += np.add.reduceat(v, cuts, axis=0)
            c[np.searchsorted(h, own[firsts])] = score.argmax(1)
        row = (table.column("shard")[0].as_py(), 0, 0, h.tobytes(), n.tobytes(), c.astype(np.uint8).tobytes())
        return pa.Table.from_batches([packed_rows([row])])

    seen = chunks.select("held", "lens", "ids", "vocab").mapInArrow(give, SHARD)
    return counts.unionByName(seen).groupBy("shard").applyInArrow(take, SHARD)


def looked_up(chunks: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """(chunk, kind 3, h: places in the chunk's vocabulary, x: counts, y: classes) from every shard."""

    def ask(batches):
        for batch in batches:
            for chunk, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(v, np.uint64)
                rows = [(s, 2, chunk, h[at].tobytes(), at.astype(np.int32).tobytes(), None) for s, at in shards_of(h, shards)]
                if rows:
                    yield packed_rows(rows)

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        known = next((i for i, x in enumerate(kind) if x == 0), None)
        if known is None:
            h, n, c = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
        else:
            h, n, c = (_array(table.column(x)[known], t) for x, t in (("h", np.uint64), ("x", np.int64), ("y", np.uint8)))
        rows = []
        for i, what in enumerate(kind):
            if what == 2:
                q = _array(table.column("h")[i], np.uint64)
                at = np.searchsorted(h, q)
                at[at == len(h)] = 0
                ok = h[at] == q if len(h) else np.zeros(len(q), bool)
                nq = (np.where(ok, n[at], 0) if len(h) else np.zeros(len(q))).astype(np.int64)
                cq = np.where(ok, c[at], 0).astype(np.uint8) if len(h) else np.zeros(len(q), np.uint8)
                rows.append((0, 3, table.column("chunk")[i].as_py(), table.column("x")[i].as_py(), squeezed64(nq), cq.tobytes()))
        return pa.Table.from_batches([packed_rows(rows)])

    asked = chunks.select("chunk", "vocab").mapInArrow(ask, SHARD)
    return words.unionByName(asked).groupBy("shard").applyInArrow(answer, SHARD)


def exchange_gains(prev: np.ndarray, nxt: np.ndarray, word: np.ndarray, own: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Log-likelihood of each word in each class, but for a constant of the word: *word* tells whose each occurrence is,
    *own* the words' classes, whose counts are in *n* and are taken out first.  A word beside itself counts as its class."""
    g = lambda x: x * np.log(np.maximum(x, 1.0))
    wide, n, m = len(n), n.astype(float), len(own)
    gain = np.zeros((m, k))
    for neighbour, by in ((nxt, n[:k]), (prev, n[:, :k].T)):
        key, x = np.unique(word * wide + neighbour.astype(np.int64), return_counts=True)
        w, j, x = key // wide, key % wide, x.astype(float)
        for a in range(0, len(w), BLOCK):
            at = slice(a, a + BLOCK)
            there = by[:, j[at]].T
            more = g(there + x[at, None]) - g(there)
            here = by[own[w[at]], j[at]]
            more[np.arange(len(here)), own[w[at]]] = g(here) - g(np.maximum(here - x[at], 0.0))
            cuts = np.flatnonzero(np.r_[True, w[at][1:] != w[at][:-1]])
            gain[w[at][cuts]] += np.add.reduceat(more, cuts, axis=0)
        total, margin = np.bincount(word, minlength=m).astype(float), by.sum(1)
        less = g(margin + total[:, None]) - g(margin)
        less[np.arange(m), own] = g(margin[own]) - g(np.maximum(margin[own] - total, 0.0))
        gain -= less
    return gain


def rest_pass(chunks: DataFrame, answers: DataFrame, words: DataFrame, fixed: np.ndarray, matrix: np.ndarray, k: int, shards: int) -> DataFrame:
    """Rows of *words* (``lexicon``) after every word that is not in *fixed* has moved to its best class."""
    start, end = k + 1, k + 2
    fixed = np.sort(fixed)

    def give(table: pa.Table) -> pa.Table:
        whole, n, c = chunk_words(table)
        held, lens = _array(table.column("held")[whole], np.uint8), _array(table.column("lens")[whole], np.int64)
        ids, vocab = unsqueezed(table.column("ids")[whole].as_py()), _array(table.column("vocab")[whole], np.uint64)
        hist, tgt, owner = sequences(held, lens, c[ids], start, end)
        inner = tgt != end
        free = ~np.isin(vocab, fixed) & (n > 0)
        ok = free[ids] & (held[owner] == 0)[inner]
        prev, nxt = hist[inner][ok], np.r_[tgt[1:], end][inner][ok]
        return pa.Table.from_batches([packed_rows(neighbour_rows(vocab, ids[ok], prev, nxt, shards) if ok.any() else [])])

    def take(table: pa.Table) -> pa.Table:
        h, n, c, own, prev, nxt = gathered(table)
        c = c.copy()
        for firsts, lo, hi in word_blocks(own):
            at = np.searchsorted(h, own[firsts])
            word = np.searchsorted(firsts, np.arange(lo, hi), side="right") - 1
            gain = exchange_gains(prev[lo:hi], nxt[lo:hi], word, c[at].astype(np.int64), matrix, k)
            stay = gain[np.arange(len(at)), c[at]]
            c[at] = np.where(gain.max(1) > stay + 1e-9, gain.argmax(1), c[at])
        row = (table.column("shard")[0].as_py(), 0, 0, h.tobytes(), n.tobytes(), c.tobytes())
        return pa.Table.from_batches([packed_rows([row])])

    seen = with_answers(chunks, answers).groupBy("chunk").applyInArrow(give, SHARD)
    return words.unionByName(seen).groupBy("shard").applyInArrow(take, SHARD)


def chunk_words(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a group of ``with_answers``: the row with the texts, and its words' counts and classes."""
    whole = next(i for i, x in enumerate(table.column("ids")) if x.is_valid)
    size = len(table.column("vocab")[whole].as_py()) // 8
    n, c = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i in range(table.num_rows):
        if i != whole:
            at = _array(table.column("h")[i], np.int32)
            n[at] = unsqueezed64(table.column("x")[i].as_py())
            c[at] = _array(table.column("y")[i], np.uint8)
    return whole, n, c


def with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of *chunks*, and those of ``looked_up`` beside them."""
    none = lambda t: F.lit(None).cast(t)
    left = chunks.select("chunk", "doc_id", "held", "lens", "ids", "vocab", *[none("binary").alias(x) for x in ("h", "x", "y")])
    right = answers.select("chunk", none("array<long>").alias("doc_id"), *[none("binary").alias(x) for x in ("held", "lens", "ids", "vocab")], "h", "x", "y")
    return left.unionByName(right)


CLASSED = "kind int, doc_id array<long>, lens binary, held binary, classes binary, known binary, base binary, emission binary, matrix binary"


def classed_chunks(chunks: DataFrame, answers: DataFrame, class_sums: np.ndarray, tokens: int, types: int, docs: int, k: int) -> DataFrame:
    """Per chunk: classes of its tokens, sums per document, and its share of the class matrix (the last column
    counts targets seen once; row ``unseen`` counts what follows words seen once)."""
    unseen, start, end, wide = k, k + 1, k + 2, k + 3
    bottom = float(tokens + types + 1)

    def run(table: pa.Table) -> pa.Table:
        whole, n, c = chunk_words(table)
        held, lens = _array(table.column("held")[whole], np.uint8), _array(table.column("lens")[whole], np.int64)
        ids = unsqueezed(table.column("ids")[whole].as_py())
        c[n == 0] = unseen
        base = np.log10((n + 1) / bottom)
        emission = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(class_sums[np.minimum(c, k - 1)], 1)), 0.0)
        owner = np.repeat(np.arange(len(lens)), lens)
        per = lambda w: np.bincount(owner, weights=w[ids], minlength=len(lens))
        known = per((n > 0).astype(float)).astype(np.int64) + (docs > 0)
        tok = c[ids]
        hist, tgt, doc = sequences(held, lens, tok, start, end)
        train = held[doc] == 0
        once = np.insert(n[ids] == 1, np.cumsum(lens), False)  # by target
        once_hist = np.insert(n[ids] == 1, np.cumsum(lens) - lens, False)
        matrix = np.zeros((wide, wide + 1), np.int64)
        matrix[:, :wide] = np.bincount(hist[train] * wide + tgt[train], minlength=wide * wide).reshape(wide, wide)
        matrix[:, wide] = np.bincount(hist[train & once], minlength=wide)
        rest = train & once_hist
        matrix[unseen, :wide] += np.bincount(tgt[rest], minlength=wide)
        matrix[unseen, wide] += int((rest & once).sum())
        return pa.table(
            {
                "kind": pa.array([0], pa.int32()),
                "doc_id": pa.array([table.column("doc_id")[whole].as_py()], pa.list_(pa.int64())),
                "lens": pa.array([lens.tobytes()], pa.binary()),
                "held": pa.array([held.tobytes()], pa.binary()),
                "classes": pa.array([tok.astype(np.uint8).tobytes()], pa.binary()),
                "known": pa.array([known.tobytes()], pa.binary()),
                "base": pa.array([(per(base) + np.log10((docs + 1) / bottom)).tobytes()], pa.binary()),
                "emission": pa.array([per(emission).tobytes()], pa.binary()),
                "matrix": pa.array([matrix.tobytes()], pa.binary()),
            }
        )

    return with_answers(chunks, answers).groupBy("chunk").applyInArrow(run, CLASSED)


def transition_logs(matrix: np.ndarray, k: int, tokens: int) -> np.ndarray:
    """log10 of the smoothed transitions [history, target]; target ``k`` is an unseen word."""
    unseen, end, wide = k, k + 2, k + 3
    counts = matrix[:, :wide].astype(float)
    counts[:, unseen] = 0
    seen = matrix[np.arange(wide) != unseen]  # that row repeats others' counts
    total = max(1.0, float(seen[:, :wide].sum()))
    once = float(seen[:, wide].sum()) / total
    a = 5.0
    p_unseen = (matrix[:, wide] + a * once) / (counts.sum(1) + a)
    p_unseen = np.clip(p_unseen, 1.0 / (tokens + 2), 0.9)
    prior = counts[np.arange(wide) != unseen].sum(0)
    targets = np.r_[np.arange(k), end]
    share = np.zeros(wide)
    share[targets] = (prior[targets] + 1) / (prior[targets] + 1).sum()
    p = (counts + a * share) / (counts.sum(1, keepdims=True) + a)
    with np.errstate(divide="ignore"):
        logs = np.log10((1 - p_unseen)[:, None] * p)
    logs[:, unseen] = np.log10(p_unseen)
    return logs


@dataclass
class Model:
    """What was learned, and the texts in its classes."""

    ready: DataFrame
    words: DataFrame
    logs: np.ndarray
    classes: int
    docs: int
    tokens: int


def learned(docs: DataFrame, folds: int, fold: int, k: int, frequent: int, passes: int, rest_passes: int) -> Model:
    """The model of the documents outside *fold*."""
    chunks = stage(chunks_of(docs, folds, fold), "chunks")
    sizes = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("vocab") / 8).alias("entries")).first()
    need = max(1.0, (sizes["entries"] or 0) / SHARD_ENTRIES * 2)
    shards = max(8, 1 << int(np.ceil(np.log2(need))))
    counts = stage(word_counts(chunks, shards), "word-counts")

    def totals(batches):
        for batch in batches:
            for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, h = np.frombuffer(x, np.int64), np.frombuffer(h, np.int64)
                top = np.argsort(-n, kind="stable")[:frequent]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] + [1] * len(top), pa.int32()), pa.array(np.r_[len(n), h[top]], pa.int64()), pa.array(np.r_[n.sum(), n[top]], pa.int64())], ["kind", "h", "n"]
                )

    facts = stage(counts.select("h", "x").mapInArrow(totals, "kind int, h long, n long"), "top-words")
    t = facts.where("kind = 0").agg(F.sum("h").alias("types"), F.sum("n").alias("tokens")).first()

    def trained(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(x.count(0) for x in batch.column(0).to_pylist())], pa.int64())], ["n"])

    docs_ = int(chunks.select("held").mapInArrow(trained, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0)
    types, tokens = int(t["types"] or 0) + (docs_ > 0), int(t["tokens"] or 0) + docs_
    top = facts.where("kind = 1").orderBy(F.desc("n"), "h").limit(frequent).select("h").toArrow()  # at most FREQUENT rows
    words = top.column("h").to_numpy().view(np.uint64)
    classes, matrix = exchange(chunks, words, k, passes, sizes["chunks"])
    lex = stage(lexicon(chunks, counts, words, classes, matrix, k, shards), "lexicon")
    ready, answers, final = in_classes(chunks, lex, tokens, types, docs_, k, shards)
    for turn in range(rest_passes if docs_ else 0):
        moved = stage(rest_pass(chunks, answers, lex, words, final[:, : k + 3], k, shards), f"rest-{turn}")
        found = in_classes(chunks, moved, tokens, types, docs_, k, shards)
        if seen_likelihood(found[2], k) <= seen_likelihood(final, k):
            break
        lex, (ready, answers, final) = moved, found
    return Model(ready, lex, transition_logs(final, k, tokens), k, docs_, tokens)


def seen_likelihood(final: np.ndarray, k: int) -> float:
    """``likelihood`` of a matrix of ``classed_chunks``, without its row of repeated counts."""
    return likelihood(np.delete(final[:, : k + 3], k, axis=0))


def in_classes(chunks: DataFrame, lex: DataFrame, tokens: int, types: int, docs: int, k: int, shards: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The chunks in the classes of *lex*, the answers that says so, and the class matrix of all training tokens."""

    def sums(batches):
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(np.frombuffer(y, np.uint8), weights=np.frombuffer(x, np.int64), minlength=k)[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n.astype(np.int64))], ["c", "n"])

    class_sums = np.zeros(k)
    for row in lex.select("x", "y").mapInArrow(sums, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row per class
        class_sums[row["c"]] = row["n"]
    release(chunks.sparkSession)
    answers = stage(looked_up(chunks, lex, shards), "answers")
    ready = stage(classed_chunks(chunks, answers, class_sums, tokens, types, docs, k), "classed")

    def added(batches):
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                x = np.frombuffer(m, np.int64)
                total = x.copy() if total is None else total + x
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    final = np.zeros((k + 3) * (k + 4), np.int64)
    for row in ready.select("matrix").mapInArrow(added, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # cells of the class matrix
        final[row["cell"]] = row["n"]
    return ready, answers, final.reshape(k + 3, k + 4)


def score_documents(
    docs: DataFrame, folds: int = 7, fold: int = 2, k: int = CLASSES, frequent: int = FREQUENT, passes: int = PASSES, rest_passes: int = REST_PASSES
) -> DataFrame:
    """One row per document: the contract's columns, learning from the documents outside *fold*."""
    model = learned(docs, folds, fold, k, frequent, passes, rest_passes)
    logs, docs_, tokens = model.logs, model.docs, model.tokens

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: _array(batch.column(name)[i], kind)  # noqa: B023, E731
                lens, held = get("lens", np.int64), get("held", np.uint8)
                hist, tgt, doc = sequences(held, lens, get("classes", np.uint8).astype(np.int64), k + 1, k + 2)
                base = get("base", np.float64)
                score = get("emission", np.float64) + np.bincount(doc, weights=logs[hist, tgt], minlength=len(lens))
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("doc_id")[i].as_py(), pa.int64()), pa.array(held == 1), pa.array(lens + 1), pa.array(get("known", np.int64)),
                        pa.array(np.full(n, tokens)), pa.array(base), pa.array(score if docs_ else base),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return model.ready.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


ship(__name__)
