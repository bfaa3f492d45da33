"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into segments that no piece crosses; the distinct new ones are
concatenated and indexed by a suffix array. Every piece of the vocabulary is looked up by binary
search, which gives all its occurrences as one range of the array. The occurrences, sorted by
position, are the edges of a lattice over the text. Relaxation then joins neighbouring symbols
along the edge of best score, leftmost first, until no edge joins any two: the order of a BPE
model's merges, done for all segments at once.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from loomtrace.llm.common import map_batches, table, text_of

#: Segments whose ids are remembered per worker.
CACHE = 400_000
#: Bytes that are indexed at once.
INDEX_BYTES = 1 << 19

# The sign that stands for a space in pieces, and the byte it is indexed as, which
# no UTF-8 text holds.
SPACE_SIGN, SPACE_BYTE = "▁", b"\xff"

# A segment: spaces and what follows them. No piece holds a line end, a NUL, or a space behind
# another sign, so none reaches over a segment's ends.
_SEGMENT = re.compile(r" *[^ \n\x00]+|[\n\x00]| +")


class Vocabulary:
    """The pieces of a BPE model with byte fallback, without normalisation but for the first space."""

    def __init__(self, model: bytes):
        processor = SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(processor.get_piece_size())
               if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        pieces = [processor.id_to_piece(i).encode().replace(SPACE_SIGN.encode(), SPACE_BYTE) for i in ids]
        scores = np.array([processor.get_score(i) for i in ids])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.pieces, self.ids = pieces, np.array(ids, dtype=np.int64)
        self.rank = rank.astype(np.int64)
        self.longest = max(map(len, pieces))
        if any(b"\n" in p or b"\0" in p or SPACE_BYTE in p.lstrip(SPACE_BYTE) for p in pieces):
            raise ValueError("a piece reaches over a segment's end")
        self.byte_ids = np.array([processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        # What each id stands for, for decoding.
        self.bytes_of = [b""] * processor.get_piece_size()
        for i, piece in zip(ids, pieces, strict=True):
            self.bytes_of[i] = piece.replace(SPACE_BYTE, b" ")
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])


def suffix_array(text: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``starts`` in the order of the ``depth`` bytes that follow them, and those bytes as numbers."""
    words = -(-depth // 8)
    padded = np.frombuffer(text + b"\0" * (8 * words), dtype=np.uint8)
    keys = []
    for w in range(words):
        key = np.zeros(len(starts), dtype=np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[starts + (8 * w + i)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return starts[order], [k[order] for k in keys]


def occurrences(keys: list[np.ndarray], piece: bytes) -> tuple[int, int]:
    """The range of the suffix array whose suffixes begin with ``piece``, by binary search."""
    low, high = 0, len(keys[0])
    for w in range(-(-len(piece) // 8)):
        part = piece[8 * w:8 * w + 8]
        least = int.from_bytes(part.ljust(8, b"\0"), "big")
        most = int.from_bytes(part.ljust(8, b"\xff"), "big")
        view = keys[w][low:high]
        low, high = (low + int(np.searchsorted(view, np.uint64(least), "left")),
                     low + int(np.searchsorted(view, np.uint64(most), "right")))
        if low == high:
            break
    return low, high


def edges_of(text: bytes, starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position * 64 + length, piece) of every occurrence of every piece, by position."""
    suffixes, keys = suffix_array(text, starts, vocabulary.longest)
    ranges = np.array([occurrences(keys, p) for p in vocabulary.pieces], dtype=np.int64).reshape(-1, 2)
    counts = ranges[:, 1] - ranges[:, 0]
    piece = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    position = suffixes[np.repeat(ranges[:, 0], counts) + inside]
    lengths = np.array([len(p) for p in vocabulary.pieces], dtype=np.int64)
    edge = position * 64 + lengths[piece]
    order = np.argsort(edge)
    return edge[order], piece[order]


def _edge_at(edges: np.ndarray, start: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
    """The index of the edge from ``start`` over ``length`` bytes, or -1."""
    wanted = start * 64 + length
    at = np.minimum(np.searchsorted(edges, wanted), max(len(edges) - 1, 0))
    there = (length <= longest) & (edges[at] == wanted if len(edges) else False)
    return np.where(there, at, -1)


def relax(start: np.ndarray, end: np.ndarray, segment: np.ndarray, edges: np.ndarray, piece: np.ndarray,
          rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, segment) of the symbols left once no edge joins two neighbours of a segment."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start) > 1:
        join = _edge_at(edges, start[:-1], end[1:] - start[:-1], longest)
        join[segment[:-1] != segment[1:]] = -1
        pairs = np.flatnonzero(join >= 0)
        if not len(pairs):
            break
        # The best pair of each segment: least rank, then leftmost.
        owner = segment[pairs]
        cost = rank[piece[join[pairs]]] * (1 << 32) + pairs
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(cost, first) & ((1 << 32) - 1)
        end[best] = end[best + 1]
        keep = np.ones(len(start), dtype=bool)
        keep[best + 1] = False
        start, end, segment = start[keep], end[keep], segment[keep]
        # Segments in which nothing was joined are finished.
        live = np.isin(segment, owner[first], assume_unique=False, kind="table") if len(segment) else keep[:0]
        if not live.all():
            done.append((start[~live], end[~live], segment[~live]))
            start, end, segment = start[live], end[live], segment[live]
    done.append((start, end, segment))
    start, end, segment = (np.concatenate(parts) for parts in zip(*done, strict=True))
    order = np.argsort(start)
    return start[order], end[order], segment[order]


def encode_segments(segments: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each segment (spaces as SPACE_BYTE), as little-endian 32-bit numbers."""
    text = b"\0".join(segments) + b"\0"
    raw = np.frombuffer(text, dtype=np.uint8)
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    signs = ((raw & 0xC0) != 0x80)
    signs[begins + lengths] = False  # the separators are no symbols
    start = np.flatnonzero(signs)
    segment = np.searchsorted(begins, start, side="right") - 1
    end = np.r_[start[1:], len(text)]
    end = np.minimum(end, (begins + lengths)[segment])
    edges, piece = edges_of(text, start, vocabulary)
    start, end, segment = relax(start, end.copy(), segment, edges, piece, vocabulary.rank, vocabulary.longest)

    found = _edge_at(edges, start, end - start, vocabulary.longest)
    known = found >= 0
    # A sign that is no piece becomes its bytes.
    sizes = np.where(known, 1, end - start)
    place = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), dtype="<u4")
    if len(edges):
        ids[place[known]] = vocabulary.ids[piece[found[known]]]
    for i in np.flatnonzero(~known):
        ids[place[i]:place[i] + sizes[i]] = vocabulary.byte_ids[raw[start[i]:end[i]]]
    cuts = np.r_[place, len(ids)][np.searchsorted(segment, np.arange(len(segments) + 1))]
    return [ids[cuts[i]:cuts[i + 1]].tobytes() for i in range(len(segments))]


class Encoder:
    """Ids of whole texts; segments met before are not indexed again."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text: the empty text has none, any other begins with a space."""
        split = [_SEGMENT.findall(" " + t.replace(SPACE_SIGN, " ")) if t else [] for t in texts]
        self._learn({s for segments in split for s in segments})
        known = self.known
        for segments in split:
            yield np.frombuffer(b"".join([known[s] for s in segments]), dtype="<u4")

    def _learn(self, segments: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        fresh, size = [], 0
        for s in segments - self.known.keys():
            if (found := self.older.get(s)) is not None:
                self.known[s] = found
            elif s in "\n\0":
                self.known[s] = self.vocabulary.byte_ids[ord(s):ord(s) + 1].astype("<u4").tobytes()
            else:
                fresh.append(s)
                size += len(s)
            if size > INDEX_BYTES:
                self._index(fresh)
                fresh, size = [], 0
        if fresh:
            self._index(fresh)

    def _index(self, fresh: list[str]) -> None:
        coded = [s.encode().replace(b" ", SPACE_BYTE) for s in fresh]
        self.known.update(zip(fresh, encode_segments(coded, self.vocabulary), strict=True))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: bytes are joined, and the space that encoding put first is dropped."""
        of = self.vocabulary.bytes_of
        text = b"".join([of[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _worker_encoder(model: bytes) -> Encoder:
    """One encoder per Python worker; it outlives the task, and so do the segments it has met."""
    kept = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders"))
    key = f"of_{zlib.crc32(model)}"
    if not hasattr(kept, key):
        setattr(kept, key, Encoder(model))
    return getattr(kept, key)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids) per row of ``docs`` (doc_id, text); null and empty texts have no ids.

    Rows may repeat and ids be null; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "ids": [i.astype(np.int32) for i in _worker_encoder(shared.value).encode(cols["text"])]}

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return map_batches(rows, work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) per row of ``encoded`` (doc_id, ids); null ids are the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict[str, list]) -> dict[str, list]:
        encoder = _worker_encoder(shared.value)
        return {"doc_id": cols["doc_id"], "text": [encoder.decode(np.array(i or [], dtype=np.int64)) for i in cols["ids"]]}

    rows = encoded.select(F.col("doc_id").cast("long"), "ids")
    return map_batches(rows, work, "doc_id long, text string")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_chars, round_trip) per row: ``encode`` and ``decode`` in one pass.

    ids_crc32 is over little-endian 32-bit ids; round_trip tells that decoding gives the text
    back (a text with the space sign of the pieces itself comes back with spaces).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict[str, list]) -> dict[str, list]:
        encoder = _worker_encoder(shared.value)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_ids": [], "ids_crc32": [], "n_chars": [], "round_trip": []}
        for text, ids in zip(cols["text"], encoder.encode(cols["text"]), strict=True):
            out["n_ids"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
            out["n_chars"].append(len(text))
            out["round_trip"].append(encoder.decode(ids) == text.replace(SPACE_SIGN, " "))
        return out

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return map_batches(rows, work, "doc_id long, n_ids long, ids_crc32 long, n_chars long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return encode_digests(table(spark, sf_dir, "documents"), model)
