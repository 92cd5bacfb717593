"""SentencePiece encoding and decoding with seeded merge-dropout.

The model is a published BPE piece model, read on the driver (its path is a
parameter) and broadcast as tables. Encoding is the agenda of BPE: the adjacent
pair with the best piece merges first, the leftmost among equals; a candidate is
skipped for good if the keyed hash of (seed, doc_id, place of the chunk, chunk,
place, piece) falls under the dropout rate, so each occurrence of a word is cut
on its own, and a document always in the same way. The agenda runs over many
chunks at once, a merge per chunk and step; chunks of over ``LONG`` characters
run their own heap. It runs once without dropout for each different chunk of a
slice, and again for each occurrence that skips any candidate met there; the
others can't differ. A chunk is a run of spaces and what follows up to the next
space or line break; no piece reaches across.

Characters without a piece, and U+2581 in a text, become byte pieces, so
decoding returns every text as it was. Defined results: null text gives null
ids, empty text an empty list; null doc_id draws as id 0; repeated rows give
equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm import textops
from scatterlake.llm.tables import table

MODEL = os.environ.get("SCATTERLAKE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SEED, DROPOUT = 20_24, 0.1
LONG = 256
SPACE = "▁"
_NONE = np.int64(1 << 40)


def load(path: str = MODEL) -> dict[str, np.ndarray]:
    """Tables of a BPE piece model: characters, mergeable pairs, ranks, byte pieces and the pieces' bytes."""
    import sentencepiece

    with open(path, "rb") as file:
        model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    n = model.get_piece_size()
    normal = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.empty(n, np.int64)
    rank[np.argsort(-scores, kind="stable")] = np.arange(n)
    chars = np.full(0x110000, -1, np.int32)
    raw = [b""] * n
    left, right, merged = [], [], []
    for piece, i in normal.items():
        raw[i] = piece.replace(SPACE, " ").encode()
        if len(piece) == 1:
            chars[ord(piece)] = i
        for k in range(1, len(piece)):
            a, b = normal.get(piece[:k]), normal.get(piece[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(i)
    chars[32], chars[ord(SPACE)] = chars[ord(SPACE)], -1
    byte = np.array([model.piece_to_id(f"<0x{k:02X}>") for k in range(256)], np.int32)
    for k, i in enumerate(byte):
        raw[i] = bytes([k])
    keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
    bits = 20
    slots, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
    for key, slot, value in zip(keys.tolist(), (textops.mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64).tolist(), merged, strict=True):
        while slots[slot] >= 0:
            slot = (slot + 1) & (1 << bits) - 1
        slots[slot], values[slot] = key, value
    sizes = np.array([len(x) for x in raw], np.int64)
    return {"chars": chars, "slots": slots, "values": values, "rank": rank, "byte": byte, "data": np.frombuffer(b"".join(raw), np.uint8), "start": np.cumsum(sizes) - sizes, "size": sizes}


def merged_piece(model: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece that each pair makes, or -1."""
    slots, values = model["slots"], model["values"]
    bits = len(slots).bit_length() - 1
    key = left.astype(np.int64) << 20 | right
    known = np.flatnonzero((left >= 0) & (right >= 0))
    out = np.full(len(left), -1, np.int32)
    key = key[known]
    slot = (textops.mix(key.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    while len(known):
        there = slots[slot]
        hit = there == key
        out[known[hit]] = values[slot[hit]]
        go = ~hit & (there >= 0)
        known, key, slot = known[go], key[go], (slot[go] + 1) & len(slots) - 1
    return out


def skipped(draw: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Which candidates the keyed hash drops; draw is the hash of seed, occurrence and chunk."""
    h = textops.mix(draw ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64)))
    return (h >> np.uint64(11)) < np.uint64(int(rate * 2**53))


def _candidates(model, ids, owner, place, draw, left, rate, tried=None):
    """Priority of the pairs that start at symbols ``left``: rank, then place; _NONE where nothing merges. What could merge goes to tried."""
    out = np.full(len(left), _NONE)
    inside = np.flatnonzero(left + 1 < len(ids))
    inside = inside[owner[left[inside]] == owner[left[inside] + 1]]
    at = left[inside]
    piece = merged_piece(model, ids[at], ids[at + 1])
    good = piece >= 0
    inside, at, piece = inside[good], at[good], piece[good]
    if tried is not None:
        tried.append((owner[at], place[at], piece))
    if rate:
        keep = ~skipped(draw[owner[at]], place[at], piece, rate)
        inside, at, piece = inside[keep], at[keep], piece[keep]
    out[inside] = model["rank"][piece] << 16 | place[at]
    return out


def agenda(model: dict[str, np.ndarray], ids: list[int], draw: int, rate: float) -> tuple[list[int], list[int]]:
    """One chunk by a heap: symbols and the places where they start."""
    n = len(ids)
    ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
    heap: list = []

    def push(a: int) -> None:
        b = after[a]
        if b >= 0:
            piece = int(merged_piece(model, np.array([ids[a]]), np.array([ids[b]]))[0])
            if piece >= 0 and not (rate and skipped(np.array([draw], np.uint64), np.array([a]), np.array([piece]), rate)[0]):
                heapq.heappush(heap, (int(model["rank"][piece]), a, b, ids[a], ids[b], piece))

    for a in range(n):
        push(a)
    gone = [False] * n
    while heap:
        _, a, b, x, y, piece = heapq.heappop(heap)
        if gone[a] or gone[b] or after[a] != b or ids[a] != x or ids[b] != y:
            continue
        ids[a], gone[b], after[a] = piece, True, after[b]
        if after[b] >= 0:
            before[after[b]] = a
        if before[a] >= 0:
            push(before[a])
        push(a)
    live = [k for k in range(n) if not gone[k]]
    return [ids[k] for k in live], live


def segment(model: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, draw: np.ndarray, rate: float, tried: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the characters ids[at[i]:at[i+1]] of each chunk; returns symbols, their chunks and places.

    With tried, which gets every candidate's chunk, place and piece, long chunks are left out.
    """
    size = np.diff(at)
    out_id, out_owner, out_place = [], [], []
    for k in np.flatnonzero(size > LONG) if tried is None else ():
        found, place = agenda(model, ids[at[k] : at[k + 1]].tolist(), int(draw[k]), rate)
        out_id.append(np.array(found, np.int32))
        out_owner.append(np.full(len(found), k))
        out_place.append(np.array(place, np.int64))
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(ids)) - np.repeat(at[:-1], size)
    short = size[owner] <= LONG
    ids, owner, place = ids[short].astype(np.int32), owner[short], place[short]
    best = _candidates(model, ids, owner, place, draw, np.arange(len(ids)), rate, tried)
    while len(ids):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(best, first)
        counts = np.diff(np.append(first, len(ids)))
        live = least < _NONE
        each = np.repeat(live, counts)
        if not live.all():
            done = ~each
            out_id.append(ids[done])
            out_owner.append(owner[done])
            out_place.append(place[done])
            ids, owner, place, best = ids[each], owner[each], place[each], best[each]
            least, counts = least[live], counts[live]
            if not len(ids):
                break
        hit = np.flatnonzero(best == np.repeat(least, counts))
        ids[hit] = merged_piece(model, ids[hit], ids[hit + 1])
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        shift = np.cumsum(keep) - 1
        ids, owner, place, best = ids[keep], owner[keep], place[keep], best[keep]
        hit = shift[hit]
        best[hit] = _candidates(model, ids, owner, place, draw, hit, rate, tried)
        left = hit[hit > 0] - 1
        left = left[owner[left] == owner[left + 1]]
        best[left] = _candidates(model, ids, owner, place, draw, left, rate, tried)
    if not out_id:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, owner, place = map(np.concatenate, (out_id, out_owner, out_place))
    order = np.argsort(owner * (int(place.max(initial=0)) + 1) + place, kind="stable")
    return ids[order], owner[order], place[order]


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _touched(tried: list, chunk: np.ndarray, draw: np.ndarray, rate: float) -> np.ndarray:
    """Which occurrences skip any candidate of their chunk's agenda without dropout."""
    owner, place, piece = (np.concatenate(x) for x in zip(*tried, strict=True))
    order = np.argsort(owner, kind="stable")
    place, piece = place[order], piece[order]
    n = np.bincount(owner, minlength=int(chunk.max()) + 1)
    start, count = (np.cumsum(n) - n)[chunk], n[chunk]
    at, of = _gather(start, count), np.repeat(np.arange(len(chunk)), count)
    out = np.zeros(len(chunk), bool)
    out[of[skipped(draw[of], place[at], piece[at], rate)]] = True
    return out


def encode(model: dict[str, np.ndarray], buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, seed: int = SEED, rate: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every text with their offsets; each non-empty text gets a space in front, as the model wants."""
    size = np.diff(offs)
    lead = (size > 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size + lead)])
    text = np.full(at[-1], 32, np.uint8)
    text[_gather(at[:-1] + lead, size)] = buf
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    line = text == 10
    edge = np.zeros(len(text), bool)
    edge[1:] = ((text[1:] == 32) & (text[:-1] != 32)) | line[1:] | line[:-1]
    edge[at[:-1][lead > 0]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(text))
    owner = np.searchsorted(at, first, "right") - 1
    chunk = textops.span_hash(textops.prefix_hash(text), first, last)
    _, which, back = np.unique(chunk, return_index=True, return_inverse=True)
    own = text[_gather(first[which], (last - first)[which])]
    heads = np.flatnonzero((own & 0xC0) != 0x80)
    chunk_at = np.searchsorted(heads, np.concatenate([[0], np.cumsum((last - first)[which])]))
    padded = np.concatenate([own, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[heads + k] for k in range(4))
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    chars, source = model["chars"][code], np.arange(len(which))
    tried: list = []
    ids, mine, place = segment(model, chars, chunk_at, np.zeros(len(which), np.uint64), 0.0, tried if rate else None)
    if rate:
        order = np.arange(len(first)) - np.searchsorted(first, at)[owner]
        draw = textops.keyed(chunk + textops.keyed(doc.view(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15) + order.astype(np.uint64), seed), seed + 1)
        own_draw = _touched(tried, back, draw, rate) | (np.diff(chunk_at) > LONG)[back]
        again = back[own_draw]
        back[own_draw] = len(which) + np.arange(len(again))
        size = np.diff(chunk_at)[again]
        more = segment(model, chars[_gather(chunk_at[again], size)], np.concatenate([[0], np.cumsum(size)]), draw[own_draw], rate)
        ids, mine, place = (np.concatenate(x) for x in zip((ids, mine, place), (more[0], more[1] + len(which), more[2]), strict=True))
        source = np.concatenate([source, again])
    count = np.ones(len(ids), np.int64)
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        char = chunk_at[source[mine[unknown]]] + place[unknown]
        width = np.diff(np.append(heads, len(own)))[char]
        count[unknown] = width
        spread = np.repeat(ids, count)
        begin = (np.cumsum(count) - count)[unknown]
        spread[_gather(begin, width)] = model["byte"][own[_gather(heads[char], width)]]
        ids, mine = spread, np.repeat(mine, count)
    ids_at = np.searchsorted(mine, np.arange(len(source) + 1))
    n = np.diff(ids_at)[back]
    out = ids[_gather(ids_at[:-1][back], n)]
    total = np.concatenate([[0], np.cumsum(n)])
    return out, total[np.searchsorted(first, at)]


def decode(model: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every list of ids, with offsets; the space in front goes."""
    size = model["size"][ids]
    data = model["data"][_gather(model["start"][ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    lead = ends[:-1][np.diff(at) > 0]
    return np.delete(data, lead), ends - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


def encoded(documents: DataFrame, model: dict[str, np.ndarray] | None = None, seed: int = SEED, rate: float = DROPOUT) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model or load())

    def run(batches):
        tables = shared.value
        for batch in batches:
            doc = np.nan_to_num(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            null = batch.column("text").is_null()
            for lo, hi, buf, offs in textops.slices(batch.column("text")):
                ids, at = encode(tables, buf, offs, doc[lo:hi], seed, rate)
                text, ends = decode(tables, ids, at)
                same = np.diff(ends) == np.diff(offs)
                if not (same.all() and np.array_equal(text, buf)):
                    same = np.array([np.array_equal(text[ends[k] : ends[k + 1]], buf[offs[k] : offs[k + 1]]) for k in range(hi - lo)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                gone = null.slice(lo, hi - lo)
                lists = pa.compute.if_else(gone, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists, pa.array(np.diff(at)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "lossless"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decoded(tokens: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id and text of rows of ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(model or load())

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            n = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            data, at = decode(shared.value, column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)]))
            raw = data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def tokenise(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, ids, n_tokens and lossless of every document."""
    return encoded(documents)
