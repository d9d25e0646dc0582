"""Packing: shortest-pack-first over the length histogram (operator 1).

1. ``tokenize_pieces`` encodes every whole text in Arrow batches and cuts it into
   pieces of at most ``max_len`` ids (the end-of-document id included).
2. The histogram of piece lengths (at most ``max_len`` numbers, whatever the size of
   the corpus) reaches the driver; ``plan_packs`` places lengths longest first, each
   into the emptiest open packs, and only ever updates counts of packs per pattern.
3. ``assign`` ranks pieces within their length by salted windows and finds each
   rank's pack by binary search in the plan.  A frequent length is spread over its
   salts, so no task sees more than a slice of it.

Edge cases: a NULL or empty text is one piece holding the end id alone; repeated rows
are packed as often as they occur; a NULL ``doc_id`` is carried through; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

EOD = 1
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")

#: the added token of the JSON file
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict = {}


def ranks(name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Token bytes -> id of the public vocabulary."""
    import public_tokenizers as P

    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(name: str = "byte_bpe_50k"):
    """The byte-level BPE of the public vocabulary, once per Python worker.

    The rank file holds the same vocabulary and splitting pattern as the JSON file and
    gives the same ids (checked over every code point in the tests) at 3-4 times the speed.
    As in the JSON file the string ``<|endoftext|>`` inside a text is one id; ``encode`` with
    ``allowed_special="all"`` gives the ids of the JSON tokenizer in its default setting.
    """
    if name not in _ENCODERS:
        import public_tokenizers as P
        import tiktoken

        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks(name),
                                           special_tokens=SPECIAL)
    return _ENCODERS[name]


def tokenize_pieces(docs: DataFrame, max_len: int = 2048, with_ids: bool = False,
                    tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece of every text."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(texts):
                got = np.array(encode(text.as_py() or "", allowed_special="all") + [EOD], dtype="<u4")
                n = len(got)
                for s in range(0, n, max_len):
                    piece = got[s:s + max_len]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(n)
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            cols = [ids_col.take(pa.array(row, pa.int64())).cast(pa.int64())]
            cols += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_packs(histogram: dict[int, int], max_len: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Shortest-pack-first on counts: ``length -> [(first_rank, count, first_pack, offset)]``.

    Open packs are kept as runs ``(fill, first_pack, count)`` of equally filled packs with
    consecutive numbers.  A length takes the emptiest run; a run larger than the rest of the
    pieces is split.  If the emptiest run has no room then none has, and new packs open, each
    taking as many pieces as fit.  Every length adds at most three runs, so the plan's size
    depends on ``max_len`` alone and not on the number of documents.
    """
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    open_runs: list[tuple[int, int, int]] = []
    packs = 0
    for length in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        left, rank, spans = histogram[length], 0, []
        while left:
            if open_runs and open_runs[0][0] + length <= max_len:
                fill, first, count = heapq.heappop(open_runs)
                take = min(left, count)
                if take < count:
                    heapq.heappush(open_runs, (fill, first + take, count - take))
                spans.append((rank, take, first, fill))
                if fill + length < max_len:
                    heapq.heappush(open_runs, (fill + length, first, take))
                rank, left = rank + take, left - take
                continue
            per_pack = max_len // length
            full, rest = divmod(left, per_pack)
            for count, copies in ((full, per_pack), (1 if rest else 0, rest)):
                if not count:
                    continue
                for k in range(copies):
                    spans.append((rank, count, packs, k * length))
                    rank += count
                if copies * length < max_len:
                    heapq.heappush(open_runs, (copies * length, packs, count))
                packs += count
            left = 0
        plan[length] = spans
    return plan


def assign(pieces: DataFrame, max_len: int = 2048, salt_rows: int = 1000, min_salts: int = 64) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"])
                 for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packs(histogram, max_len)
    largest = max(histogram.values(), default=0)
    salts = max(min_salts, min(1 << 16, largest // (salt_rows * 1000) + 1))
    # by the piece, not by its id alone: pieces under one id, or none, still spread
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    before = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")
                                                    .rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")))
    ranked = (salted.withColumn("rank", F.row_number().over(
                  Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
              .join(before, ["length", "salt"])
              .withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before"))
    # bounded by max_len (see plan_packs), not by the corpus
    shared = spark.sparkContext.broadcast(
        {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in plan.items()})
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        table = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(bounds, np.append(bounds[1:], len(order))):
                at = order[a:b]
                first_rank, _, first_pack, fill = table[int(length[at[0]])]
                k = np.searchsorted(first_rank, rank[at], "right") - 1
                seq[at] = first_pack[k] + rank[at] - first_rank[k]
                offset[at] = fill[k]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(seq), pa.array(offset)],
                                             names + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack whole documents; one row per piece with its place, and its ids if asked for."""
    return assign(scratch(tokenize_pieces(docs, max_len, with_ids), "pack-pieces"), max_len)


def sequences(packed: DataFrame, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """Build the padded sequences (``sequence_id, ids, doc_ids, n_tokens``) of ``pack(..., with_ids=True)``.

    A group holds at most ``max_len`` ids, so collecting it is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return out.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(max_len) - F.col("n_tokens")).cast("int"))).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), "n_tokens")


def find_pack(spans, rank: int) -> tuple[int, int]:
    """Pack and offset of one rank (the scalar form of the lookup, for checks)."""
    k = bisect_right([s[0] for s in spans], rank) - 1
    first_rank, _, first_pack, fill = spans[k]
    return first_pack + rank - first_rank, fill
