"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Each task turns its documents into ids and cuts them: runs of a whole sequence go out as they are, what remains is cut
into pieces, and pieces are gathered into groups of bounded size.  In a group every piece starts as a partial partition
of one piece; the two partial partitions with the widest spread are merged with opposing order, the fullest windows of
one against the emptiest of the other, until one partition of near-equal windows is left.  Where a window exceeds the
capacity the number of windows rises and the group is partitioned anew.  The last group of a task gives up its last few
ids to sequences of power-of-two lengths, which need no padding.  No data is shuffled: groups never leave the
task that read them, and a source or group of copies of any size is spread as its rows are.

Cases: a null or empty text is one piece with the end id alone; rows with equal ids are separate documents, told apart
by no column; very long texts become many whole sequences; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, small_batches, tidy
from .tokens import cached, tokenizer_path

CAPACITY, END_ID = 2048, 1
#: Remainders are cut to at most this many ids, so that windows hold several pieces and even out.
PIECE = 256
#: Ids in a group: 1024 windows.
GROUP_IDS = 1024 * CAPACITY

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of `lengths` in k windows of near-equal sums (Karmarkar-Karp). A partial partition is kept as its
    nonempty windows, in falling order of their sums; the others are empty."""
    heap: list = []
    for i, n in enumerate(lengths):
        heap.append((-n, i, [(n, (i,))]))
    heapq.heapify(heap)
    ticket = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - k
        if overlap <= 0:
            merged = a + b
        else:
            # the fullest of b on the emptiest of a: windows of a from the end, windows of b from the start
            keep_a, keep_b = a[: len(a) - overlap], b[: len(b) - overlap]
            joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - overlap :], reversed(b[len(b) - overlap :]), strict=True)]
            merged = keep_a + keep_b + joined
        merged.sort(key=_sum, reverse=True)
        if len(merged) == k and merged[-1][0] > 0:
            base = merged[-1][0]
            spread = merged[0][0] - base
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, ticket, merged))
        ticket += 1
    windows = [_flat(t) for _, t in heap[0][2]] if heap else []
    return windows


def _sum(window: tuple) -> int:
    return window[0]


def _flat(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def windows_of(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest near-equal windows, counted up from the lower bound, of which none exceeds the capacity."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return found
        k += max(1, k // 400)


def last_windows(lengths: list[int], capacity: int = CAPACITY) -> tuple[int, list[list[int]] | None]:
    """For the last group of a task: (ids to cut off its end, windows of the rest).  The ids cut off fill sequences of
    power-of-two lengths, which need no padding; the rest fills whole windows nearly to the capacity."""
    total = sum(lengths)
    k = total // capacity
    for slack in (4, 8, 16, 32, 64):
        cut = total - k * (capacity - slack)
        kept, rest = [], total - cut
        for n in lengths:
            if rest > 0:
                kept.append(min(n, rest))
                rest -= kept[-1]
        found = difference(kept, k) if k else []
        if all(sum(kept[i] for i in w) <= capacity for w in found):
            return cut, found
    return 0, None


def powers_of_two(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths that sum to n, each a power of two and at most the capacity."""
    top = 1 << (capacity.bit_length() - 1)
    return [top] * (n // top) + [1 << b for b in range(top.bit_length() - 2, -1, -1) if (n % top) >> b & 1]


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32)."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    group_ids = GROUP_IDS // CAPACITY * capacity

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokenizer, sequence, end = cached(path), TaskContext.get().partitionId() << 33, end_id.to_bytes(4, "little")
        held: list[tuple] = []
        held_ids = 0
        rows: list[tuple] = []

        def close(last: bool = False) -> None:
            nonlocal sequence, held, held_ids
            cut, windows = last_windows([p[2] for p in held], capacity) if last else (0, None)
            if windows is not None:
                close_tail(cut)
            for window in windows_of([p[2] for p in held], capacity) if windows is None else windows:
                offset = 0
                for i in sorted(window):
                    doc_id, start, n, total, data = held[i]
                    rows.append((doc_id, start, n, total, sequence, offset, data))
                    offset += n
                sequence += 1
            held, held_ids = [], 0

        def close_tail(cut: int) -> None:
            """Cuts the last `cut` ids off the held pieces and lays them into sequences of power-of-two lengths."""
            nonlocal sequence
            tail: list[tuple] = []
            while cut > 0:
                doc_id, start, n, total, data = held.pop()
                n_cut = min(n, cut)
                if n_cut < n:
                    held.append((doc_id, start, n - n_cut, total, data[: 4 * (n - n_cut)]))
                tail.append((doc_id, start + n - n_cut, n_cut, total, data[4 * (n - n_cut) :]))
                cut -= n_cut
            for room in powers_of_two(sum(p[2] for p in tail), capacity):
                offset = 0
                while offset < room:
                    doc_id, start, n, total, data = tail.pop()
                    n_now = min(n, room - offset)
                    rows.append((doc_id, start, n_now, total, sequence, offset, data[: 4 * n_now]))
                    if n_now < n:
                        tail.append((doc_id, start + n_now, n - n_now, total, data[4 * n_now :]))
                    offset += n_now
                sequence += 1

        def frame() -> pd.DataFrame:
            out = pd.DataFrame([r[1:] for r in rows], columns=["start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
            rows.clear()
            return out

        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                for doc_id, text in zip([None if n else d for d, n in zip(part["doc_id"].tolist(), part["doc_id_null"].tolist(), strict=True)], part["text"], strict=True):
                    data = tokenizer.encode(text or "") + end
                    total, at = len(data) // 4, 0
                    while total - at >= capacity:
                        rows.append((doc_id, at, capacity, total, sequence, 0, data[4 * at : 4 * (at + capacity)]))
                        sequence += 1
                        at += capacity
                    while at < total:
                        n = min(piece, total - at)
                        held.append((doc_id, at, n, total, data[4 * at : 4 * (at + n)]))
                        held_ids += n
                        at += n
                    if held_ids >= group_ids:
                        close()
                if len(rows) >= 2000:
                    yield frame()
        if held:
            close(last=True)
        if rows:
            yield frame()

    return docs.select(*id_columns("doc_id"), "text").mapInPandas(tidy(pack), SCHEMA)


def packed_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
