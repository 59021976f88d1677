"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts are cut into pieces of at most the longest length (every word once, an
end token after the last), so nothing is dropped.  Pieces go to groups by a
hash of their document and piece number; the number of groups follows the
total length, so a group has a bounded number of tokens whatever the input,
and each is packed by one task: pieces in falling order, each into the open
bin with the least room that takes it; if none does, a bin of the length
whose expected cost per filled token is least is opened (a bin costs its
length plus a fixed overhead; what is left to place bounds how full it can
get); at the end each bin shrinks to the least permitted length that holds
its contents.

Defined results: null and empty texts are one end token; an empty table gives
no rows; repeated rows are packed each; ties go by document id and piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaysync.llm.common import own_columns, read, slices, staged, text_buffer
from relaysync.llm.tokens import SPACE_WORDS, word_spans

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
GROUP_TOKENS = 400_000


def _pieces_map(longest: int):
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in slices(off, 8 << 20):
                n = np.bincount(word_spans(buf, off[lo: hi + 1], SPACE_WORDS)[2], minlength=hi - lo) + 1
                k = -(-n // longest)
                row = np.repeat(np.arange(hi - lo), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                length = np.minimum(longest, n[row] - piece * longest)
                yield pa.record_batch([batch.column(0).take(pa.array(row + lo)), pa.array(piece.astype(np.int32)),
                                       pa.array((piece * longest).astype(np.int64)), pa.array(length.astype(np.int32))],
                                      names=[batch.schema.names[0], "piece", "first_token", "n_tokens"])

    return run


def best_fit(sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD):
    """(bin of each piece, offset in it, length of each bin) for sizes in falling order."""
    lengths = sorted(lengths)
    left = sum(sizes)
    rooms: list[int] = []  # distinct rooms of open bins, rising
    bins_at: dict[int, list[int]] = {}  # a stack of bins for each room
    used: list[int] = []
    length: list[int] = []
    where, offset = [], []
    for size in sizes:
        i = bisect.bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            b = bins_at[room].pop()
            if not bins_at[room]:
                del bins_at[room]
                rooms.pop(i)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, max(size, left)), c))
            b = len(used)
            used.append(0)
            length.append(room)
        where.append(b)
        offset.append(used[b])
        used[b] += size
        left -= size
        room -= size
        if room:
            if room not in bins_at:
                bins_at[room] = []
                bisect.insort(rooms, room)
            bins_at[room].append(b)
    return where, offset, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def _pack_apply(lengths, overhead, id_col):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_tokens", id_col, "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        where, offset, length = best_fit(f["n_tokens"].tolist(), lengths, overhead)
        where = np.array(where, dtype=np.int64)
        return f.assign(bin_id=(np.int64(key[0]) << 32) + where, bin_offset=np.array(offset, dtype=np.int32),
                        bin_length=np.array(length, dtype=np.int32)[where]).drop(columns="grp")

    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, id_col: str = "doc_id",
         column: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, piece, first_token, n_tokens, bin_id, bin_offset, bin_length.

    ``id_col`` must be a long column.
    """
    pieces = staged(own_columns(docs, id_col, column).mapInArrow(
        _pieces_map(max(lengths)), f"`{id_col}` long, piece int, first_token long, n_tokens int"), "pieces")
    total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    return (pieces.withColumn("grp", F.pmod(F.xxhash64(id_col, "piece", "n_tokens"), F.lit(groups)).cast("int"))
            .groupBy("grp").applyInPandas(_pack_apply(tuple(lengths), overhead, id_col),
                                          f"`{id_col}` long, piece int, first_token long, n_tokens int, bin_id long, bin_offset int, bin_length int"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 512 to 8,192 words."""
    return pack(read(spark, sf_dir, "documents"))
