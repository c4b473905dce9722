"""Problem 7: the whole corpus as token ids of a public tokenizer, by content-defined chunk reuse.

Texts are cut where a rolling hash over their bytes says so, so that what documents share is cut alike in all of them. A first
pass counts the chunks by their digests; no text leaves its task. In the second pass a chunk that occurs once is encoded where it
lies, together with its neighbours of the same kind. Only chunks that occur more often travel, and each is encoded once, from
its first to its last safe boundary; where two parts meet, the text between the last safe boundary of the one and the first of the
next is encoded anew, over as many parts as it takes to reach one. A safe boundary is a place at which every
left-to-right scan of the tokenizer's pattern must break, so that the ids on its two sides never depend on each other; hence the
result agrees exactly with encoding the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.session import cut_lineage, hot_split_join

#: Where the rank file of byte_bpe_50k lies; a parameter of every operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Safe boundaries, from characters whose class no version of Unicode disputes: a space after a letter, digit or mark;
#: a mark or digit after a letter, a letter or mark after a digit, a digit after a mark. (A letter after a mark
#: is not safe because of 's, 't and the like, nor is anything after a space.)
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯа-яА-Яぁ-ゖァ-ヺ一-鿕가-힣"
_MARK = "!-/:-@\\[-`{-~、。"
SAFE = re.compile(
    f"(?<=[{_LETTER}0-9{_MARK}])(?=[ \\n\\r\\t])|(?<=[{_LETTER}])(?=[{_MARK}0-9])|(?<=[0-9])(?=[{_LETTER}{_MARK}])|(?<=[{_MARK}])(?=[0-9])"
)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer, loaded once a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def outer_boundaries(text: str) -> tuple[int, int] | None:
    """The first and the last safe boundary of a text, null if it has fewer than two; looks only as far from the ends as it must."""
    first = SAFE.search(text)
    if first is None:
        return None
    width = 64
    while True:
        at = [m.start() for m in SAFE.finditer(text, max(first.end(), len(text) - width))]
        if at and at[-1] > first.start():
            return first.start(), at[-1]
        if len(text) - width <= first.end():
            return None
        width *= 4


def id_kind(path: str) -> type:
    """The narrowest type of the tokenizer's ids, in which they travel between tasks."""
    return np.uint16 if encoder(path).max_token_value < 1 << 16 else np.uint32


# -- chunks ------------------------------------------------------------------------------------------------------------

_WINDOW, _BLOCK = 32, 1 << 15
_GEAR = np.frombuffer(hashlib.shake_128(b"gear").digest(1024), np.uint32)


def cut_points(data: np.ndarray, starts: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Byte positions at which texts lying one after the other in `data`, from `starts` on, are cut, the starts included.

    A cut follows a window of 32 bytes within one text whose gear hash has `bits` leading zeros, moved on to the
    next whole character. Stretches without any are cut every `longest` bytes.
    """
    found = []
    for begin in range(0, len(data), _BLOCK):  # a block at a time stays in the processor's cache
        first = max(0, begin - _WINDOW + 1)
        h = _GEAR[data[first : begin + _BLOCK]]
        for w in (1, 2, 4, 8, 16):
            h[w:] += h[:-w] << np.uint32(w)
        found.append(np.flatnonzero(h[begin - first :] < np.uint32(1 << (32 - bits))) + begin + 1)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))
    def whole(at):
        for _ in range(3):
            inside = at < len(data)
            at = at + (inside & ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80))
        return at
    at = whole(at)
    of = np.searchsorted(starts, at, side="right") - 1
    at = at[(at - starts[of] >= _WINDOW) & (at < ends[of])]
    cuts = np.unique(np.concatenate([starts, at]))
    gaps = np.diff(np.append(cuts, len(data)))
    if (gaps > longest).any():
        more = [np.arange(c + longest, c + g, longest) for c, g in zip(cuts[gaps > longest], gaps[gaps > longest], strict=True)]
        cuts = np.unique(np.concatenate([cuts, whole(np.concatenate(more))]))
        cuts = cuts[cuts < len(data)]
    return cuts


#: Slots of the bit map of repeated chunks: half a megabyte at any size. Chunks that share a slot with a repeated one travel like it.
SLOT_BITS = 22


def _digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _slot(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") & ((1 << SLOT_BITS) - 1)


def _cut(texts: list[bytes], bits: int, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(index, chunk bounds from 0 to the text's length) of each text that is not empty."""
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(texts[i]) for i in full], np.int64)
    starts = np.cumsum(lengths) - lengths
    cuts = cut_points(data, starts, bits, longest)
    bounds = np.searchsorted(cuts, np.append(starts, len(data)))
    for k, i in enumerate(full):
        yield i, [*(cuts[bounds[k] : bounds[k + 1]] - starts[k]).tolist(), len(texts[i])]


def _keys(bits: int, longest: int):
    """Digest and slot of every chunk."""

    def run(batches):
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            keys = [_digest(texts[i][a:b]) for i, cut in _cut(texts, bits, longest) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([_slot(k) for k in keys], pa.int32())], ["key", "slot"])

    return run


_PART_SCHEMA = "doc_id bigint, doc_key binary, pos int, key binary, chunk string, head string, body binary, tail string"


def _parts(bits: int, longest: int, path: str, repeated):
    """The parts of each document: (pos, key, chunk) of a chunk whose slot is in the bit map `repeated`, (pos, head, body, tail) of a stretch of others.

    A document of other chunks alone is one part without head and tail, at pos -1; an empty text is one part of nothing, at pos 0.
    """

    def run(batches):
        enc, kind = encoder(path), id_kind(path)
        marks = np.frombuffer(repeated.value, np.uint8)
        ids_of = lambda s: np.array(enc.encode_ordinary(s), kind).tobytes()
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
            rows = [(docs[i], b"", 0, None, None, None, None, None) for i, t in enumerate(texts) if not t]
            for i, cut in _cut(texts, bits, longest):
                t, doc = texts[i], docs[i]
                keys = [_digest(t[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                slots = [_slot(k) for k in keys]
                common = [bool(marks[s >> 3] >> (s & 7) & 1) for s in slots]
                if not any(common):
                    rows.append((doc, None, -1, None, None, None, ids_of(t.decode()), None))
                    continue
                doc_key, k = _digest(t), 0
                while k < len(keys):
                    if common[k]:
                        rows.append((doc, doc_key, k, keys[k], t[cut[k] : cut[k + 1]].decode(), None, None, None))
                        k += 1
                        continue
                    first = k
                    while k < len(keys) and not common[k]:
                        k += 1
                    text = t[cut[first] : cut[k]].decode()
                    at = outer_boundaries(text) or (None, None)
                    a, b = 0 if first == 0 else at[0], len(text) if k == len(keys) else at[1]
                    if a is None or b is None:
                        rows.append((doc, doc_key, first, None, None, text, None, ""))
                    else:
                        rows.append((doc, doc_key, first, None, None, text[:a], ids_of(text[a:b]), text[b:]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in _PART_SCHEMA.split(", ")])

    return run


def _encode_chunks(path: str):
    """A chunk as (head, body, tail): body has the ids between the first and the last safe boundary; it is null, and head the whole
    chunk, where there are not two of them."""

    def run(batches):
        enc, kind = encoder(path), id_kind(path)
        for batch in batches:
            heads, bodies, tails = [], [], []
            for text in batch.column("chunk").to_pylist():
                at = outer_boundaries(text)
                if at is None:
                    heads.append(text), bodies.append(None), tails.append("")
                else:
                    heads.append(text[: at[0]]), bodies.append(np.array(enc.encode_ordinary(text[at[0] : at[1]]), kind).tobytes()), tails.append(text[at[1] :])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("uses"), pa.array(heads, pa.string()), pa.array(bodies, pa.binary()), pa.array(tails, pa.string())],
                ["key", "uses", "head", "body", "tail"],
            )

    return run


def _unpacked(path: str):
    """Bytes of ids as lists."""

    def run(batches):
        kind = np.dtype(id_kind(path))
        for batch in batches:
            column = batch.column("body")
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // kind.itemsize
            flat = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])

    return run


def _repair(path: str):
    """A document's parts, joined: each stretch between two bodies is encoded as one text."""

    def run(batches):
        enc, kind = encoder(path), id_kind(path)
        ids_of = lambda s: np.array(enc.encode_ordinary(s), np.int32)
        often = lru_cache(maxsize=20_000)(ids_of)
        seam_ids = lambda s: often(s) if len(s) < 200 else ids_of(s)
        for batch in batches:
            column = batch.column("parts")
            parts = column.flatten()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pos, heads, bodies, tails = parts.flatten()
            pos, heads, bodies, tails = pos.to_pylist(), heads.to_pylist(), bodies.to_pylist(), tails.to_pylist()
            out, sizes, begin = [], [], 0
            for end in ends:
                size, seam, last = 0, "", None
                for k in sorted(range(begin, end), key=pos.__getitem__):
                    if pos[k] == last or heads[k] is None:
                        continue
                    last, seam = pos[k], seam + heads[k]
                    if bodies[k] is not None:
                        if seam:
                            out.append(seam_ids(seam))
                            size += len(out[-1])
                        out.append(np.frombuffer(bodies[k], kind))
                        size += len(out[-1])
                        seam = tails[k]
                if seam:
                    out.append(seam_ids(seam))
                    size += len(out[-1])
                sizes.append(size)
                begin = end
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return run


def corpus_ids(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, bits: int = 10, longest: int = 8192) -> DataFrame:
    """(doc_id BIGINT, ids ARRAY<INT>) of every document: its token ids without special tokens, exactly as if encoded whole.

    Null and empty texts give an empty list; names of special tokens in a text are ordinary text. Equal rows come
    out once; an id that has several texts comes out once for each. Null ids are kept. Extra columns don't matter; an empty table gives no rows.
    tokenizer: path of the rank file. bits: chunks are about 2^bits bytes; longest: at most so many, whole texts all the same.

    Scale: nothing but digests is shuffled of chunks that occur once. What tells the second pass which ones do is a bit map of fixed size
    (half a megabyte); where very many chunks are repeated it says so of others as well, which then travel too and come out
    the same. A chunk in a third of all documents is encoded once, and its rows are spread over many tasks where it is joined back.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_keys(bits, longest), "key binary, slot int").groupBy("key", "slot").agg(F.count("*").alias("uses"))
    marks = counted.filter("uses > 1").groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits")).toArrow()
    repeated = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    repeated[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    parts = cut_lineage(rows.mapInArrow(_parts(bits, longest, tokenizer, spark.sparkContext.broadcast(repeated.tobytes())), _PART_SCHEMA))

    whole = parts.filter("pos = -1").select("doc_id", "body").mapInArrow(_unpacked(tokenizer), "doc_id bigint, ids array<int>")
    shared = parts.filter("key IS NOT NULL")
    encoded = shared.groupBy("key", "chunk").agg(F.count("*").alias("uses")).mapInArrow(_encode_chunks(tokenizer), "key binary, uses bigint, head string, body binary, tail string")
    refs = shared.select("doc_id", "doc_key", "pos", "key")
    counts = refs.groupBy("key").agg(F.count("*").alias("uses"))
    joined = hot_split_join(refs, encoded, "key", "uses", shared.count(), F.col("doc_key"), "inner", counts, parts=100)
    others = parts.filter("pos >= 0 AND key IS NULL")
    columns = ["doc_id", "doc_key", "pos", "head", "body", "tail"]
    pieces = joined.select(columns).unionByName(others.select(columns))
    pieces = pieces.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("pos", "head", "body", "tail")).alias("parts"))
    return whole.unionByName(pieces.select("doc_id", "parts").mapInArrow(_repair(tokenizer), "doc_id bigint, ids array<int>"))


def with_token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id BIGINT, doc_key BINARY, n_tokens INT) of every row: a digest of its text and its length in tokens (0 for null)."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            sizes = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "doc_key", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, doc_key binary, n_tokens int")
