"""Operator 5: byte-level BPE encoding and decoding with forced-boundary splitting.

A token is a run of bytes.  Two bytes that stand side by side inside no token of the vocabulary can never end up in
one token, so a text may be cut between them without changing its encoding.  The encoder cuts at such pairs on two
levels: before white space that follows something else (one scan of the text; the constructor proves from the
vocabulary that every such pair is a forced boundary, and the splitting pattern cuts there too), and, inside the
pieces that the splitting pattern leaves, at every remaining forced pair.  Fragments are encoded independently by
merging the lowest-ranked pair until none is left, and their ids are concatenated.  A bounded cache keeps fragments
that were seen, which for natural text is nearly all of them.

Decoding looks up the bytes of each id, joins them and reads them as UTF-8 (bad sequences become U+FFFD).

Edge cases: a null text is read as empty; an empty text has no tokens; strings of special tokens inside a text are
that token, as the vocabulary file says; other columns are ignored; rows are independent of each other, so copies and
ties need no rule.  The vocabulary is a parameter: its path, or its content when the executors cannot read the path.
A text is encoded whole by one task, fragment by fragment.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, kept

#: The pattern of byte-level BPE that splits text before merging, and the white space it knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

CACHED_FRAGMENTS = 700_000
NO_RANK = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBpe:
    def __init__(self, content: str):
        spec = json.loads(content)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        names = {token: bytes(letters[c] for c in token) for pair in spec["model"]["merges"] for token in (pair.split(" ") if isinstance(pair, str) else pair)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: i for k, i in vocab.items() if k.decode("utf-8", "replace") not in self.special or i not in self.special.values()}
        self.bytes_of = {i: k for k, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.shared = {i: i for i in self.bytes_of}
        self.byte_id = {k[0]: i for k, i in vocab.items() if len(k) == 1}
        #: (left id, right id) as one number -> (rank, merged id) as one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[names[a]] << 32 | vocab[names[b]]] = rank << 32 | vocab[names[a] + names[b]]
        self.inside = {(x, y) for token in vocab for x, y in zip(token, token[1:])}
        endings = {c.encode()[0] for c in WHITE}
        blanks = {b for b in endings if b < 0x80}
        if not all(x in blanks or x >= 0x80 for x, y in self.inside if y in blanks):
            raise ValueError("a token holds white space after something else; this vocabulary needs another first cut")
        self.first_cut = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pieces = regex.compile(SPLIT).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        cuts = [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in self.inside]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merge(self, fragment: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair of neighbours has a rank."""
        if len(fragment) > 200:
            return self._merge_long(fragment)
        ids, get = [self.byte_id[b] for b in fragment], self.merges.get
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            ids[i] = self.shared[low & 0xFFFFFFFF]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_RANK)
        return ids

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for fragments whose pairs are too many to look through each time."""
        ids, n = [self.byte_id[b] for b in fragment], len(fragment)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(low, i, ids[i], ids[i + 1]) for i in range(n - 1) if (low := self.merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = self.shared[low & 0xFFFFFFFF], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (found := self.merges.get(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> list[int]:
        parts = self.fragments(piece.encode())
        return self.merge(parts[0]) if len(parts) == 1 else [i for part in parts for i in self.merge(part)]

    def _new(self, fragment: str) -> tuple[int, ...]:
        """The ids of a fragment that is not in the cache; they and those of its pieces are kept."""
        if len(self.seen) >= CACHED_FRAGMENTS:
            self.seen.clear()
        pieces, out = self.pieces(fragment), []
        for piece in pieces:
            ids = self.seen.get(piece)
            if ids is None:
                ids = tuple(self._piece(piece))
                if len(piece) <= 64:
                    self.seen[piece] = ids
            out.extend(ids)
        if 1 < len(pieces) and len(fragment) <= 64:
            self.seen[fragment] = tuple(out)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k & 1:
                out.append(self.special[part])
                continue
            get, add, new = self.seen.get, out.extend, self._new
            for fragment in self.first_cut.findall(part):
                add(get(fragment) or new(fragment))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _codec(content: str) -> ForcedBoundaryBpe:
    return kept(hashlib.sha256(content.encode()).hexdigest(), lambda: ForcedBoundaryBpe(content))


def vocabulary(path: str | None = None) -> str:
    """The content of a vocabulary file; the public byte-level one if no path is given.  About 1.6 MB, whatever the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (unless ``keep_ids`` is off), ids_sha256, and decoded_sha256 of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(content or vocabulary())
    listed = "ids array<int>, " if keep_ids else ""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, render = _codec(shared.value), {}
        for batch in batches:
            n, ids_hash, text_hash, lists = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids))
                for i in set(ids).difference(render):
                    render[i] = str(i)
                ids_hash.append(hashlib.sha256(",".join(map(render.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if keep_ids:
                    lists.append(ids)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if keep_ids:
                columns = {"doc_id": batch.column(0), "n_tokens": columns["n_tokens"], "ids": pa.array(lists, pa.list_(pa.int32())), "ids_sha256": columns["ids_sha256"], "decoded_sha256": columns["decoded_sha256"]}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoded, f"doc_id long, n_tokens long, {listed}ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), keep_ids=False)
