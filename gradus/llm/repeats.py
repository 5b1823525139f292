"""Passages that stand in a collection more than once: what the two substring operators share.

Both ask which windows of ``width`` consecutive symbols (bytes or words) also start earlier.  The steps:

1. ``stored`` writes the texts once, compressed, each row under a key of its own, so ids may repeat.
2. ``run_table`` cuts every text into runs of windows with one anchor (``winnow``); a run travels as its anchor hash, the
   hash of all it covers, and its place.  Equal windows have equal anchors, so they meet under one anchor hash.  Runs
   whose symbols equal those of an earlier run of the same slice of rows are set apart before the shuffle, so a passage
   in a third of all documents sends a row per slice.
3. ``classified`` streams the runs in order of (anchor, content, place).  Hashes only place candidates: a run whose
   content hash stands earlier is *claimed* to equal the run before it, and ``checked`` compares the symbols themselves.
   Runs of one anchor with different contents are *mixed*: some of their windows may be equal, which the operator's own
   method tells; their first occurrences go on to it.  Runs whose anchor has one content only are originals.
4. ``pieces`` brings the texts to claimed and mixed runs and cuts out what these cover, neighbouring claims as one piece.
5. The operator finds the repeated spans among the contexts of each anchor (suffix array or relative Lempel-Ziv).
6. ``with_spans`` brings all spans to the documents.

If a comparison fails, two contents share their hashes: the claims of those anchors are void, and all their runs go
through the operator's method.  So no result depends on a hash.

Bounds.  Long texts are cut in pieces of ``PIECE`` windows.  An anchor at the edge of a passage that very many documents
share would meet that many contents: a first pass finds such *hot* anchors (``hot_anchors``), whose runs are dealt window
by window instead, each under its own hash.  Contexts of any other anchor beyond ``MOST_BYTES`` are dealt window by
window afterwards (``leftovers``), so a task holds a batch, a slice or a shard, whatever the anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm import winnow
from gradus.llm.common import written

RUN = "anchor long, content long, doc_id long, row long, start int, stop int, copy boolean"
PLACE = "kind int, anchor long, doc_id long, row long, start int, stop int, src long, src_start int"
PART = "anchor long, doc_id long, row long, start int, stop int, src long, src_start int, context binary"
SPAN = "row long, start int, stop int"
COPY, MIXED, CLAIM = 0, 1, 2
SLICE, SLICE_BYTES = 2048, 64 << 20  # a slice of rows ends at either
PIECE = 1 << 19  # windows of a text that are cut at once
HOT, HOT_BITS, TRACKED = 1024, 20, 1 << 15  # an anchor with more contents than the first is hot; how many a task tracks
MOST_BYTES = 32 << 20  # of contexts of one anchor in a shard


class View(Protocol):
    """A text as a sequence of symbols."""

    n: int

    def values(self, start: int, stop: int) -> np.ndarray:
        """Hashes of the symbols, unsigned 64-bit numbers."""

    def cut(self, start: int, stop: int) -> bytes:
        """The symbols, in a form that is equal for equal symbols only."""


Search = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def stored(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(row, doc_id, packed): the texts as compressed UTF-8 under a key for each row; null is read as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = [squeeze((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "doc_id", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(pack, "row long, doc_id long, packed binary"), f"{name}-texts")


def _sliced(batches: Iterator[pa.RecordBatch], view: Callable[[bytes], View]) -> Iterator[tuple[np.ndarray, np.ndarray, list[View]]]:
    """(rows, ids, texts) of slices of rows."""
    for batch in batches:
        rows, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("row", "doc_id"))
        at, size, views = 0, 0, []
        for k, data in enumerate(batch.column("packed")):
            data = unpacked(data.as_py())
            views.append(view(data))
            size += len(data)
            if size >= SLICE_BYTES or len(views) == SLICE or k + 1 == batch.num_rows:
                yield rows[at : k + 1], ids[at : k + 1], views
                at, size, views = k + 1, 0, []


def _runs(text: View, width: int, gram: int, hot: np.ndarray) -> Iterator[winnow.Runs]:
    """The runs of a text, piece by piece; those of hot anchors window by window."""
    for at in range(0, text.n - width + 1, PIECE):
        values = text.values(at, min(at + PIECE + width - 1, text.n))
        found = _by_window(values, winnow.runs(values, width, gram), hot, width)
        yield winnow.Runs(found.gram, found.content, found.start + at, found.stop + at)


def _by_window(values: np.ndarray, runs: winnow.Runs, hot: np.ndarray, width: int) -> winnow.Runs:
    """The runs with those of hot anchors replaced by one run for each window, under two hashes of the window."""
    if not len(hot):
        return runs
    anchors = runs.gram.view(np.int64)
    at = np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)
    split = hot[at] == anchors
    if not split.any():
        return runs
    sizes = (runs.stop - runs.start)[split]
    start = np.repeat(runs.start[split] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    hashes = [winnow.Hashes(v).span(start, start + width) for v in (winnow.mixed(values), values)]
    parts = [(runs.gram[~split], hashes[0]), (runs.content[~split], hashes[1]), (runs.start[~split], start), (runs.stop[~split], start + 1)]
    merged_parts = [np.concatenate(p) for p in parts]
    order = np.argsort(merged_parts[2], kind="stable")
    return winnow.Runs(*(p[order] for p in merged_parts))


def _together(slice_: tuple[np.ndarray, np.ndarray, list[View]], width: int, gram: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of a slice, with the number of their text in it."""
    found = [(k, r) for k, text in enumerate(slice_[2]) for r in _runs(text, width, gram, hot)]
    if not found:
        return {"anchor": np.zeros(0, np.int64)}
    names = {"anchor": 0, "content": 1, "start": 2, "stop": 3}
    return {name: np.concatenate([r[k] for _, r in found]).view(np.int64) for name, k in names.items()} | {"text": np.repeat([k for k, _ in found], [len(r.start) for _, r in found])}


def _fewer(anchors: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many counters, each less by the count of the first that is left out (the frequent-items bound)."""
    if len(anchors) <= most:
        return anchors, counts
    less = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    keep = counts > less
    return anchors[keep], counts[keep] - less


def hot_anchors(texts: DataFrame, view: Callable[[bytes], View], width: int, gram: int) -> np.ndarray:
    """The anchors of very many runs, sorted; at most ``2 ** HOT_BITS`` of them, whatever the input.

    Every task counts the anchors of its slices (a content once a slice) with ``TRACKED`` counters, each of which is short
    by at most the task's runs divided by ``TRACKED``.  So an anchor that is not found has fewer contents than ``HOT``
    plus the share of all runs that 2 ** -15 is, about what a task reads.
    """
    none = np.zeros(0, np.int64)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, anchors, counts = 0, none, none
        for slice_ in _sliced(batches, view):
            own = _together(slice_, width, gram, none)
            total += len(own["anchor"])
            if not len(own["anchor"]):
                continue
            different = np.unique(own["anchor"] ^ winnow.mixed(own["content"].view(np.uint64)).view(np.int64), return_index=True)[1]
            new, n = np.unique(own["anchor"][different], return_counts=True)
            merged_anchors, place = np.unique(np.concatenate([anchors, new]), return_inverse=True)
            anchors, counts = _fewer(merged_anchors, np.bincount(place, np.concatenate([counts, n])).astype(np.int64), TRACKED)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array([*anchors[often].tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), total], pa.int64())], ["anchor", "n"])

    counts = written(texts.where("doc_id is not null").mapInArrow(told, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.where("anchor is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = counts.where(F.col("anchor").isNotNull() & (F.col("n") >= max(HOT, total >> HOT_BITS))).select("anchor").toPandas()
    return np.sort(found["anchor"].to_numpy(np.int64))


def _later(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, within_docs: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (anchor, content, doc, start): where the content of each begins, and which repeat it later."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = doc > doc[head]
    if within_docs:
        later |= start > start[head]
    return head, later


def _joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs as one: (first run of each, starts, stops); with ``shift`` only runs of equal shifts join.

    The runs come in order of (row, start).
    """
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1]) | (False if shift is None else shift[1:] != shift[:-1]))
    first = np.flatnonzero(new)
    return first, start[first], np.maximum.reduceat(stop, first)


def run_table(texts: DataFrame, view: Callable[[bytes], View], width: int, gram: int, within_docs: bool, hot: np.ndarray) -> DataFrame:
    """The runs of all texts; ``copy`` marks spans of runs that equal an earlier one of the same slice."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in _sliced(batches, view):
            rows, ids, views = slice_
            own = _together(slice_, width, gram, shared.value)
            if not len(own["anchor"]):
                continue
            own |= {"doc_id": ids[own["text"]].astype(np.int64), "row": rows[own["text"]]}
            if (ids[1:] < ids[:-1]).any():  # a stable sort by content then leaves each content in order of place
                order = np.lexsort((own["start"], own["doc_id"]))
                own = {k: v[order] for k, v in own.items()}
            order = np.argsort(own["anchor"] ^ winnow.mixed(own["content"].view(np.uint64)).view(np.int64), kind="stable")
            by = {k: v[order] for k, v in own.items()}
            head, late = _later(by["anchor"], by["content"], by["doc_id"], by["start"], within_docs)
            late = np.flatnonzero(late)
            text, start, stop = (by[k].tolist() for k in ("text", "start", "stop"))
            same = [views[text[a]].cut(start[a], stop[a] + width - 1) == views[text[b]].cut(start[b], stop[b] + width - 1) for a, b in zip(late.tolist(), head[late].tolist())]
            copy = np.zeros(len(order), bool)
            copy[order[late[np.array(same, bool)]]] = True
            done = {k: v[copy] for k, v in own.items()}
            if copy.any():
                in_order = np.lexsort((done["start"], done["row"]))
                done = {k: v[in_order] for k, v in done.items()}
                first, begin, end = _joined(done["row"], done["start"], done["stop"])
                done = {k: v[first] for k, v in done.items()} | {"start": begin, "stop": end, "anchor": winnow.mixed(done["row"][first].view(np.uint64)).view(np.int64)}  # dealt evenly
            kept = {k: np.concatenate([v[~copy], done[k]]) for k, v in own.items()}
            flags = np.append(np.zeros(int((~copy).sum()), bool), np.ones(len(done["row"]), bool))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(kept[k]) for k in ("anchor", "content", "doc_id", "row")), pa.array(kept["start"], pa.int32()), pa.array(kept["stop"], pa.int32()), pa.array(flags)],
                ["anchor", "content", "doc_id", "row", "start", "stop", "copy"],
            )

    return texts.where("doc_id is not null").mapInArrow(cut, RUN)


def classified(runs: DataFrame, within_docs: bool) -> DataFrame:
    """Places: copies, claims with the place they are to equal, and first occurrences of the contents of mixed anchors."""
    names = ["anchor", "content", "doc_id", "start", "stop", "row"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the firsts of the last anchor, while it has one content
        known: int | None = None  # the last anchor, once it is known to be mixed
        last: list[dict[str, np.ndarray]] = []  # the first and the latest run of the last content

        def out(kind: int, rows: dict[str, np.ndarray], src: pa.Array | None = None, src_start: pa.Array | None = None) -> pa.RecordBatch:
            n = len(rows["row"])
            columns = [pa.array(np.full(n, kind, np.int32)), *(pa.array(rows[k]) for k in ("anchor", "doc_id", "row", "start", "stop"))]
            columns += [pa.nulls(n, pa.int64()) if src is None else src, pa.nulls(n, pa.int32()) if src_start is None else src_start]
            return pa.RecordBatch.from_arrays(columns, ["kind", "anchor", "doc_id", "row", "start", "stop", "src", "src_start"])

        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            done = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
            if done.any():
                yield out(COPY, {k: v[done] for k, v in rows.items()})
                rows = {k: v[~done] for k, v in rows.items()}
            if not len(rows["anchor"]):
                continue
            ahead = len(last)
            every = {k: np.concatenate([*(p[k] for p in last), rows[k]]) for k in names} if last else rows
            head, late = _later(every["anchor"], every["content"], every["doc_id"], every["start"], within_docs)
            last = [{k: every[k][at : at + 1] for k in names} for at in (head[-1], len(head) - 1)]
            late[:ahead] = False
            at = np.flatnonzero(late)
            if len(at):
                yield out(CLAIM, {k: v[at] for k, v in every.items()}, pa.array(every["row"][at - 1]), pa.array(every["start"][at - 1]))
            firsts = np.flatnonzero(~late[ahead:]) + ahead
            own = {k: v[firsts] for k, v in every.items()} | {"new": head[firsts] == firsts}
            if held is not None:
                own = {k: np.concatenate([held[k], v]) for k, v in own.items()}
            anchor = own["anchor"]
            if not len(anchor):
                continue
            begins = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            several = np.add.reduceat(own["new"].astype(np.int64), begins) > 1
            several[0] |= known is not None and anchor[0] == known
            chosen = np.repeat(several, np.diff(np.append(begins, len(anchor))))
            if chosen.any():
                yield out(MIXED, {k: v[chosen] for k, v in own.items()})
            known = int(anchor[-1]) if several[-1] else None
            held = None if several[-1] else {k: v[begins[-1] :] for k, v in own.items()}

    ordered = runs.repartition("anchor").sortWithinPartitions("copy", "anchor", "content", "doc_id", "start")
    return ordered.mapInArrow(told, PLACE)


def pieces(texts: DataFrame, places: DataFrame, view: Callable[[bytes], View], width: int) -> DataFrame:
    """What mixed runs cover (src is null), and what claims cover, neighbours with neighbouring sources as one piece."""
    fields = ("anchor", "start", "stop", "src", "src_start")
    wanted = places.where(F.col("kind") != COPY).groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column("wanted")
                asked, text = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                claim = asked.field("src").is_valid().to_numpy(zero_copy_only=False)
                anchor, start, stop, src, src_start = (asked.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in fields)
                shift, mixed, own = start - src_start, np.flatnonzero(~claim), np.flatnonzero(claim)
                own = own[np.lexsort((start[own], shift[own], src[own], text[own]))]
                begin, end = start[own], stop[own]
                if len(own):
                    target = np.cumsum(np.append(True, (text[own][1:] != text[own][:-1]) | (src[own][1:] != src[own][:-1])))
                    first, begin, end = _joined(target, begin, end, shift[own])
                    own = own[first]
                pick, begin, end = np.concatenate([mixed, own]), np.concatenate([start[mixed], begin]), np.concatenate([stop[mixed], end])
                order = np.argsort(text[pick], kind="stable")
                pick, begin, end, none = pick[order], begin[order], end[order], (np.arange(len(pick)) < len(mixed))[order]
                doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "row"))
                packed, last, opened = batch.column("packed"), -1, None
                for a in range(0, len(pick), 4096):
                    part, context = slice(a, a + 4096), []
                    of = text[pick[part]]
                    for t, s, e in zip(of.tolist(), begin[part].tolist(), end[part].tolist()):
                        if t != last:
                            last, opened = t, view(unpacked(packed[t].as_py()))
                        context.append(opened.cut(s, e + width - 1))
                    columns = [pa.array(anchor[pick[part]]), pa.array(doc[of]), pa.array(row[of]), pa.array(begin[part], pa.int32()), pa.array(end[part], pa.int32())]
                    columns += [pa.array(src[pick[part]], mask=none[part]), pa.array(src_start[pick[part]], pa.int32(), mask=none[part]), pa.array(context, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "row", "start", "stop", "src", "src_start", "context"])

    return texts.join(wanted, "row").select("row", "doc_id", "packed", "wanted").mapInArrow(cut_out, PART)


def checked(texts: DataFrame, parts: DataFrame, view: Callable[[bytes], View], width: int) -> DataFrame:
    """(row, start, stop, same): claimed pieces compared with what stands at their source."""
    claims = parts.where("src is not null").select(F.col("src").alias("key"), "row", "start", "stop", "src_start", F.col("context").alias("data"))
    sources = texts.select(F.col("row").alias("key"), *[F.lit(None).cast(t).alias(n) for n, t in (("row", "long"), ("start", "int"), ("stop", "int"), ("src_start", "int"))], F.col("packed").alias("data"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, text = b"", None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in ("row", "start", "stop", "src_start", "data")]
            for row, start, stop, src_start, data in zip(*columns):
                if row is None:  # a source comes before what is claimed of it
                    packed, text = data, None
                    continue
                if text is None:
                    text = view(unpacked(packed))
                out.append((row, start, stop, text.cut(src_start, src_start + stop - start + width - 1) == data))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["row", "start", "stop", "same"])

    met = sources.unionByName(claims).repartition("key").sortWithinPartitions("key", F.col("row").asc_nulls_first())
    return met.mapInArrow(compared, f"{SPAN}, same boolean")


def in_shards(found: DataFrame, search: Search, shard_bytes: int, width: int) -> DataFrame:
    """(row, start, stop, doc_id, context): the repeated spans among contexts, searched in shards of whole anchors.

    A shard closes at the first change of anchor after ``shard_bytes``.  Contexts of an anchor with more than ``MOST_BYTES``
    come back as they are, with their context.
    """
    names = ["row", "start", "stop", "doc_id", "context"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (anchor, docs, rows, starts, stops, contexts) of this shard
        size, own, beyond = 0, 0, None  # bytes held, of the last anchor, and that anchor once it has too many

        def close(parts: list[tuple]) -> pa.RecordBatch:
            rows, starts = np.concatenate([h[2] for h in parts]), np.concatenate([h[3] for h in parts]).astype(np.int64)
            of, start, stop = search(np.concatenate([h[1] for h in parts]), starts, [c for h in parts for c in h[5]])
            return pa.RecordBatch.from_arrays([pa.array(rows[of], pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.binary())], names)

        def back(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            for h in parts:
                yield pa.RecordBatch.from_arrays([pa.array(h[2]), pa.array(h[3]), pa.array(h[4]), pa.array(h[1]), pa.array(h[5], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, doc, row, start, stop = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "doc_id", "row", "start", "stop"))
            parts = batch.column("context").to_pylist()
            change = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for a, b in zip(change, change[1:]):
                group = (anchor[a], doc[a:b], row[a:b], start[a:b], stop[a:b], parts[a:b])
                if beyond is not None and anchor[a] == beyond:
                    yield from back([group])
                    continue
                if held and held[-1][0] != anchor[a]:
                    own = 0
                    if size >= shard_bytes:
                        yield close(held)
                        held, size = [], 0
                held.append(group)
                more = sum(map(len, group[5]))
                size, own = size + more, own + more
                if own > MOST_BYTES:
                    beyond = anchor[a]
                    yield from back([h for h in held if h[0] == beyond])
                    held = [h for h in held if h[0] != beyond]
                    size, own = size - own, 0
        if held:
            yield close(held)

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return ordered.mapInArrow(searched, f"{SPAN}, doc_id long, context binary")


def leftovers(found: DataFrame, view: Callable[[bytes], View], width: int, within_docs: bool) -> DataFrame:
    """(row, start, stop): repeated windows among contexts, each window compared with those of its hash."""
    names = ["key", "doc_id", "row", "start", "stop", "window"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, int]] = {}
            out, columns = [], [batch.column(k).to_pylist() for k in ("row", "start", "stop", "doc_id", "context")]
            for row, start, stop, doc, context in sorted(zip(*columns), key=lambda r: (r[3], r[1])):
                text = view(context)
                keys = winnow.Hashes(text.values(0, text.n)).every(width).view(np.int64).tolist()
                for k in range(stop - start):
                    window = text.cut(k, k + width)
                    doc_0, start_0 = first.setdefault(window, (doc, start + k))
                    late = doc > doc_0 or (within_docs and start + k > start_0)
                    out.append((keys[k], doc, row, start + k, start + k + width, None if late else window))  # null: known to be a repeat
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, {}
        for batch in batches:
            out, columns = [], [batch.column(k).to_pylist() for k in names]
            for own, doc, row, start, stop, window in zip(*columns):
                if own != key:
                    key, first = own, {}
                doc_0, start_0 = first.setdefault(window, (doc, start)) if window is not None else (doc, start)
                if window is None or doc > doc_0 or (within_docs and start > start_0):
                    out.append((row, start, stop))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["row", "start", "stop"])

    windows = found.where("context is not null").mapInArrow(dealt, "key long, doc_id long, row long, start int, stop int, window binary")
    return windows.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(compared, SPAN)


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, packed, spans): the texts with all their repeated spans, unordered and overlapping; null for none."""
    own = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(own, "row", "left").select("doc_id", "packed", "spans")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one, in order."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]


def spans_of(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if value.as_py() is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(*(value.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop")))


def repeated(docs: DataFrame, view: Callable[[bytes], View], search: Search, width: int, gram: int, within_docs: bool, shard_bytes: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All steps: (doc_id, packed, spans)."""
    texts = stored(docs, id_col, text_col, name)
    runs = run_table(texts, view, width, gram, within_docs, hot_anchors(texts, view, width, gram))
    places = written(classified(runs, within_docs), f"{name}-places")
    parts = written(pieces(texts, places, view, width), f"{name}-pieces")
    claims = written(checked(texts, parts, view, width), f"{name}-claims")
    copies = places.where(F.col("kind") == COPY).select("row", "start", "stop")
    mixed, false = parts.where("src is null"), claims.where("not same")
    if not false.isEmpty():  # contents that share their hashes
        inside = (F.col("start") >= F.col("from")) & (F.col("stop") <= F.col("to"))
        claimed = places.where(F.col("kind") == CLAIM)
        anchors = written(claimed.join(false.select("row", F.col("start").alias("from"), F.col("stop").alias("to")), "row").where(inside).select("anchor").distinct(), f"{name}-false")
        claims = claimed.join(anchors, "anchor", "left_anti").select("row", "start", "stop")
        again = runs.where("not copy").join(anchors, "anchor", "left_semi").select(F.lit(MIXED).alias("kind"), "anchor", "doc_id", "row", "start", "stop", F.lit(None).cast("long").alias("src"), F.lit(None).cast("int").alias("src_start"))
        mixed = mixed.join(anchors, "anchor", "left_anti").unionByName(pieces(texts, again, view, width))
    found = written(in_shards(mixed, search, shard_bytes, width), f"{name}-spans")
    ends = copies.unionByName(claims.select("row", "start", "stop")).withColumn("stop", F.col("stop") + (width - 1))
    spans = ends.unionByName(found.where("context is null").select("row", "start", "stop")).unionByName(leftovers(found, view, width, within_docs))
    return with_spans(texts, spans)
