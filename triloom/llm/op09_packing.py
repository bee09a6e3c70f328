"""Best-fit packing of tokenized documents into sequences.

Documents are cut into pieces of at most one sequence, range-sorted by length and placed in
supersteps, longest first. In a superstep all documents of one length seek their successor among
the gaps, the least room that holds them; conflicts are resolved by rank: rank r of the length
takes place r in the sweep over gaps of that room and then of the next. Then the gaps shrink and
the next length follows. Lengths and rooms run from 1 to the sequence length, and equal ones are
interchangeable, so a sweep works on runs (length, count) and (room, sequences): what the driver
holds is bounded by the square of the sequence length, whatever the input. The documents find their
places by joining their rank with the sweeps' matches.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, prepare, ranked, unused
from triloom.llm.memory import trimmed

END = 2
#: The added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def encoder(vocabulary: str | None):
    """Byte-level BPE by ranks: the ids of byte_bpe_50k.json, in a quarter of the time."""
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str | None, added: bool):
    """The tokenizer itself, for texts that `encoder` refuses."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(str(vocabulary).replace(".tiktoken", ".json") if vocabulary else public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = not added
    return out


def token_ids(text: str | None, vocabulary: str | None = None, added: bool = False) -> np.ndarray:
    """The ids of a text (null: none) and the end id. With `added`, strings of added tokens get
    their id, as the tokenizer does by itself; else they are ordinary text. The fast encoder's
    pattern search has a bounded stack, which a run of about a million blanks exceeds: such a text
    goes to the tokenizer as a whole."""
    try:
        ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all" if added else set(), disallowed_special=())
    except ValueError:
        ids = np.array(tokenizer(vocabulary, added).encode(text, add_special_tokens=False).ids, "<u4")
    return np.append(ids.astype("<u4"), np.uint32(END))


def cuts(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % room or min(n, room)
    return [(0, first), *((s, room) for s in range(first, n, room))]


def tokenized_pieces(docs: DataFrame, room: int = 1024, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (little-endian 32-bit ids) and, on request, ids; the
    ids are those of the tokenizer at its default settings, added tokens included."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = token_ids(text, vocabulary, added=True)
                for k, (s, n) in enumerate(cuts(len(t), room)):
                    rows.append((doc, k, s, n, zlib.crc32(t[s : s + n].tobytes())))
                    if with_ids:
                        ids.append(t[s : s + n].astype("i4"))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))] if with_ids else cols, [*names, "ids"] if with_ids else names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def sweeps(counts: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Matches (length, first rank, end rank, first sequence, documents a sequence, offset) and the
    number of sequences, for counts of documents by length."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
    rooms: list[int] = []
    out, sequences = [], 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if not runs.get(left):
                bisect.insort(rooms, left)
            runs.setdefault(left, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                gap = rooms[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    rooms.pop(at)
            else:  # no successor: open as many sequences as the rest of this length fills
                gap, first, n = room, sequences, -(-todo // (room // length))
                sequences += n
            each = gap // length
            full = min(n, todo // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, room - gap))
                give(gap - each * length, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and 0 < todo < each:
                out.append((length, rank, rank + todo, first, each, room - gap))
                give(gap - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            give(gap, first, n)
    return out, sequences


def pack(pieces: DataFrame, room: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to rows with a length from 1 to room.

    pieces should be a written table: it is read for the ranks' range bounds and for the sort.
    Repeated rows are placed one by one; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    if counts and not 1 <= min(counts) <= max(counts) <= room:
        raise ValueError(f"lengths must lie in 1..{room}")
    matches, _ = sweeps(counts, room)
    above, base = 0, []
    for length in sorted(counts, reverse=True):
        base.append((length, above))
        above += counts[length]
    (rank,) = unused(columns, "_rank")
    order = [F.col("length").desc(), F.xxhash64(*[F.col(f"`{c}`") for c in columns])]
    placed, _ = ranked(scratch, pieces.select(*[F.col(f"`{c}`") for c in columns]), order, rank)
    first = dict(base)
    lo, hi, seq, each, off, slot = unused(columns, "_lo", "_hi", "_seq", "_each", "_off", "_slot")
    plan = spark.createDataFrame([(first[m[0]] + m[1], first[m[0]] + m[2], *m[3:]) for m in matches], f"`{lo}` long, `{hi}` long, `{seq}` long, `{each}` long, `{off}` long")
    # Matches are disjoint intervals of ranks: they and the documents meet by slot of ranks, an equal
    # join whose sides adaptive execution may broadcast or split by their sizes.
    wide = max(16, above // max(1, len(matches)))
    plan = plan.withColumn(slot, F.explode(F.sequence(F.floor(F.col(lo) / wide), F.floor((F.col(hi) - 1) / wide))))
    hit = placed.withColumn(slot, F.floor(F.col(rank) / wide)).join(plan, slot).where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    nth = F.col(rank) - F.col(lo)
    return hit.select(
        *[F.col(f"`{c}`") for c in columns],
        (F.col(seq) + F.floor(nth / F.col(each))).alias("sequence_id"),
        (F.col(off) + (nth % F.col(each)) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, room: int = 1024, vocabulary: str | None = None, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset for every piece of every document.

    Null text counts as empty and becomes a piece with the end id alone. Only documents of more
    than `room` ids are cut. Rows that repeat a doc_id are packed each by itself. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    return pack(scratch.cut(tokenized_pieces(docs, room, vocabulary, with_ids), "pieces"), room, scratch)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with ids: the training sequences themselves. A group is bounded by the sequence length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
