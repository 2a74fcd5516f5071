"""Best-fit packing with bound-certified repacking.

Every document becomes token ids and an end id; longer ones than a sequence are cut into full
pieces and one shorter first piece.  Full pieces are sequences by themselves.  The others are dealt
to partitions, each packed by best-fit decreasing.  Dual feasible functions give each partition a
lower bound on its sequences: a partition that meets its bound is certified and final.  Partitions
with a gap keep their full sequences and exchange the documents of the rest: these are dealt anew, to
as many partitions as they fill, and packed again, until all are certified, one partition holds what is
left, or a round leaves as many documents open as it got.  No partition ever gets more than about ``per_partition`` rows.

Defined results: a null text is an empty text and packs as its end id alone; repeated rows are packed
each on their own; an empty table packs to nothing; texts of any length are tokenized whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import ship, stage, tidy

PIECE = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return table


class Encoder:
    """Ids of a byte-level BPE vocabulary file (tokenizers JSON).

    The merges of such a file are in order of rank, so tiktoken's byte-pair engine, which is several
    times as fast, gives the same ids from the vocabulary as ranks; `tests/llm` holds the two
    against each other.  Texts with the string of an added token go through the file's own library,
    which reads it as that token and is loaded at the first of them: a second vocabulary in the memory of
    every worker, which few tables need.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        table = byte_alphabet()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces_of(ids: list[int], room: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) with only the first piece shorter than *room*."""
    n = len(ids)
    blob = struct.pack(f"<{n}I", *ids)
    first = n % room or min(n, room)
    cuts = [0, *range(first, n + 1, room)]
    return [(k, a, b - a, zlib.crc32(blob[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int, text_col: str = "text") -> DataFrame:
    """A row per piece; full ones carry a sequence id of their own."""
    src = docs.select(F.col("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, made = Encoder(tokenizer), 0
        own = (1 << 62) | (TaskContext.get().partitionId() << 36)
        for batch in batches:
            docs_, out = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):  # one text at a time as a Python string
                for k, start, length, crc in pieces_of([*encoder.ids(text.as_py() or ""), end_id], room):
                    docs_.append(i)
                    made += 1
                    for x, v in zip(out, (k, start, length, crc, own + made if length == room else None), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs_, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"],
            )

    return src.mapInArrow(tidy(run), PIECE.format(kind) + ", sequence_id long")


def lower_bound(lengths: list[int], room: int) -> int:
    """Sequences that *lengths* need at least: the best of the area bound and two families of dual
    feasible functions.

    f_e(x) = 1 if x > 1 - e, x if e <= x, 0 below e; and u_k(x) = x if (k+1)x is whole, else
    floor((k+1)x)/k (Fekete and Schepers 2001).  All in integers.
    """
    count = [0] * (room + 1)
    for x in lengths:
        count[x] += 1
    used = [x for x in range(1, room + 1) if count[x]]
    best = -(-sum(x * count[x] for x in used) // room)
    for e in range(1, room // 2 + 1):
        if count[e] or count[room - e] or e == room // 2:
            total = sum(count[x] * (room if x > room - e else x) for x in used if x >= e)
            best = max(best, -(-total // room))
    for k in range(1, 33):
        total = sum(count[x] * ((k + 1) * x // room * room if (k + 1) * x % room else k * x) for x in used)
        best = max(best, -(-total // (k * room)))
    return best


def best_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the used length of each bin.

    Bins are kept by free length with a bit mask of the free lengths in use, so the tightest bin is
    found in constant time.
    """
    n = len(lengths)
    bins, offsets, used = [0] * n, [0] * n, []
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        x = lengths[i]
        fit = mask >> x
        if fit:
            free = x + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = room, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += x
        if free > x:
            by_free[free - x].append(b)
            mask |= 1 << (free - x)
    return bins, offsets, used


def _packed(room: int, level: int, last: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]

    def run(batches):
        batches = list(batches)  # at most a partition's share, per_partition rows
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lengths = table.column("length").to_pylist()
        bins, offsets, used = best_fit_decreasing(lengths, room)
        gap = len(used) - lower_bound(lengths, room)
        mine = (level << 46) | (TaskContext.get().partitionId() << 20)  # below the ids of full pieces
        again = not last and gap > 0
        table = table.select(names[:5])
        table = table.append_column("sequence_id", pa.array([mine + b for b in bins], pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("open", pa.array([again and used[b] < room for b in bins], pa.bool_()))
        yield from table.to_batches(max_chunksize=50_000)

    return tidy(run)


def pack(pieces: DataFrame, room: int = 1024, per_partition: int = 60_000, label: str = "pack") -> DataFrame:
    """Place *pieces* (``tokenized_pieces``) in sequences: adds ``sequence_id`` and ``offset``."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [pieces.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long")).select(*names)]
    pool = pieces.where("sequence_id is null").drop("sequence_id")
    left = pool.count()
    level, parts = 1, max(1, -(-left // per_partition))
    while left:
        out = pool.repartition(parts).mapInArrow(
            _packed(room, level, parts == 1), PIECE.format(kind) + ", sequence_id long, offset long, open boolean"
        )
        out = stage(out, f"{label}-{level}")
        before, left = left, out.where("open").count() if parts > 1 else 0
        if left == before:  # nothing closed: what each partition has stays as it is
            done.append(out.select(*names))
            break
        done.append(out.where("not open").select(*names))
        pool = out.where("open").select(*names[:5])
        parts = max(1, -(-left // per_partition))
        level += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Tokenize whole texts and pack them."""
    return pack(stage(tokenized_pieces(docs, tokenizer, room, end_id), "pieces"), room, **options)


ship(__name__)
