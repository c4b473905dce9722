"""Problem 9: oversized texts cut into pieces at natural boundaries, by balanced targets.

The least number of pieces gives equal targets; each end is moved to the strongest boundary near its target that leaves room for
the rest, each start to a natural boundary at most `overlap` tokens back. Where a limit can't be kept, or a cut finds
no boundary though its piece has one, one piece more is tried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.llm.tokens import TOKENIZER, encoder, outer_boundaries

#: Strength of a boundary: the end of a paragraph, line, sentence or word before a space, the end of a word beside a mark,
#: or none but between two whole characters.
PARAGRAPH, LINE, SENTENCE, WORD, MARK, NONE, BROKEN = 5, 4, 3, 2, 1, 0, -1
KINDS = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", MARK: "word", NONE: "none"}


@lru_cache(maxsize=2)
def _features(path: str):
    """Of every token, what boundaries depend on."""
    enc = encoder(path)
    n = enc.max_token_value + 1
    pure, starts, whole = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
    newlines, ends, wide = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    size, first, last = np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int8)
    for b in enc.token_byte_values():
        i = enc.encode_single_token(b)
        text = b.decode("utf-8", "replace")
        pure[i] = text.isspace()
        starts[i] = text[0].isspace()
        whole[i] = (b[0] & 0xC0) != 0x80
        newlines[i] = text.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        ends[i] = text.rstrip("\"')]}*_»”’")[-1:] in tuple(".!?…;:") and not text[-1].isspace()
        wide[i] = text[-1] in "。！？"
        # 1: a letter or digit, 2: a mark, 0: a space or a part of a character
        first[i], last[i] = (0 if c.isspace() or c == "\ufffd" else 1 if c.isalnum() else 2 for c in (text[0], text[-1]))
        size[i] = len(b)
    return pure, starts, whole, newlines, ends, wide, first, last, size


def boundary_strengths(ids: np.ndarray, path: str) -> np.ndarray:
    """The strength of the boundary before each token, and of the text's end: len(ids) + 1 values."""
    pure, starts, whole, newlines, ends, wide, first, last, _ = _features(path)
    out = np.full(len(ids) + 1, NONE)
    out[0] = out[-1] = PARAGRAPH
    if len(ids) < 2:
        return out
    a, b = ids[:-1], ids[1:]
    k = np.arange(len(ids))
    # newlines in the run of blank tokens that ends with each token
    total = np.cumsum(newlines[ids])
    before = np.maximum.accumulate(np.where(pure[ids], -1, k))
    run = np.where(pure[ids], total - np.where(before >= 0, total[before], 0), 0)[:-1]
    inner = out[1:-1]
    inner[last[a] * first[b] == 2] = MARK
    word_end = ~pure[a] & starts[b]
    inner[word_end] = WORD
    inner[word_end & ends[a]] = SENTENCE
    inner[wide[a]] = SENTENCE
    after_blank = pure[a] & ~pure[b]
    inner[after_blank] = WORD
    inner[after_blank & (run == 1)] = LINE
    inner[after_blank & (run > 1)] = PARAGRAPH
    inner[~whole[b]] = BROKEN
    return out


def split_points(strength: np.ndarray, limit: int, overlap: int, pieces: int | None = None) -> list[tuple[int, int]] | None:
    """(start, end) of each piece over len(strength) - 1 tokens, for a number of pieces (default: the least); None if that can't be done well.

    Neighbours overlap by at most `overlap` tokens; every piece has at most `limit`.
    """
    n, step = len(strength) - 1, limit - overlap
    k = pieces or max(1, 1 + -(-(n - limit) // step))
    out, start = [], 0
    for i in range(k):
        if i == k - 1:
            end = n
            if end - start > limit:
                return None
        else:
            target = start + round((n - start + (k - i - 1) * overlap) / (k - i))
            lo = max(start + overlap + 1, n - (k - i - 1) * step)
            hi = min(start + limit, n - 1)
            if lo > hi:
                return None
            near = max(16, limit // 8)
            end = _strongest(strength, max(lo, target - near), min(hi, target + near), target)
            if end is None or strength[end] <= NONE:
                wider = _strongest(strength, lo, hi, target)
                end = wider if wider is not None and (end is None or strength[wider] > strength[end]) else end
            if end is None:
                return None
            if strength[end] <= NONE and pieces_could_help(strength, start + overlap + 1, lo):
                return None
        out.append((start, end))
        if i < k - 1:
            start = _start(strength, end, overlap, out[-1][0])
    return out


def pieces_could_help(strength: np.ndarray, first: int, lo: int) -> bool:
    """Whether a shorter piece would find a natural end."""
    return bool((strength[first:lo] > NONE).any())


def _strongest(strength: np.ndarray, lo: int, hi: int, target: int) -> int | None:
    """The strongest boundary in lo..hi, of equals the one nearest to the target."""
    if lo > hi:
        return None
    s = strength[lo : hi + 1]
    top = s.max()
    if top == BROKEN:
        return None
    at = np.flatnonzero(s == top) + lo
    return int(at[np.argmin(np.abs(at - target))])


def _start(strength: np.ndarray, end: int, overlap: int, last_start: int) -> int:
    """Where the next piece starts: `overlap` tokens before `end`, or a few fewer if a natural boundary is there."""
    first = max(end - overlap, last_start + 1, 0)
    s = strength[first : min(first + max(1, overlap // 4), end) + 1]
    for least in (WORD, MARK, NONE):
        at = np.flatnonzero(s >= least)
        if len(at):
            return first + int(at[0])
    return end  # no whole character begins there


class _Pieces:
    """Ranges of a text's tokens as texts, and how many tokens such a text has if it is encoded by itself."""

    def __init__(self, ids: np.ndarray, raw: bytes, path: str):
        self.enc, self.raw = encoder(path), raw
        self.offsets = np.concatenate([[0], np.cumsum(_features(path)[-1][ids])])
        self.known: dict[tuple[int, int], int] = {}

    def text(self, a: int, b: int) -> bytes:
        return self.raw[self.offsets[a] : self.offsets[b]]

    def own_tokens(self, a: int, b: int) -> int:
        """Only what lies before the first and after the last safe boundary can be encoded differently than in the whole text."""
        if (a, b) not in self.known:
            t = self.text(a, b).decode("utf-8", "replace")
            at = outer_boundaries(t)
            if at is None:
                n = len(self.enc.encode_ordinary(t))
            else:
                head, tail = t[: at[0]], t[at[1] :]
                i = np.searchsorted(self.offsets, self.offsets[a] + len(head.encode()))
                j = np.searchsorted(self.offsets, self.offsets[b] - len(tail.encode()))
                n = len(self.enc.encode_ordinary(head)) + int(j - i) + len(self.enc.encode_ordinary(tail))
            self.known[a, b] = n
        return self.known[a, b]


def split_ids(ids: np.ndarray, limit: int, overlap: int, path: str, raw: bytes | None = None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, strength of the end, text) of each piece of a text's tokens (raw: the text's bytes, if at hand).

    Pieces are added until every limit holds, that of each piece's own text encoded by itself included. Where even twice the least number of
    balanced pieces keeps some piece above the limit, the text is cut from its start on, each piece as long as its own encoding allows.
    """
    pieces, strength = _Pieces(ids, raw if raw is not None else encoder(path).decode_bytes(ids.tolist()), path), boundary_strengths(ids, path)
    least = max(1, 1 + -(-(len(ids) - limit) // (limit - overlap)))
    for k in range(least, 2 * least + 3):
        points = split_points(strength, limit, overlap, k)
        if points is not None and all(pieces.own_tokens(a, b) <= limit for a, b in points):
            break
    else:
        points = _from_the_start(strength, limit, overlap, pieces)
    return [(a, b, int(max(strength[b], NONE)), pieces.text(a, b)) for a, b in points]


def _from_the_start(strength: np.ndarray, limit: int, overlap: int, pieces: _Pieces) -> list[tuple[int, int]]:
    """Pieces one after the other, each ending at the strongest boundary in its second half, shortened until its own encoding is within the limit.

    A whole character has four tokens at most, so each piece can end at least one character after the one before.
    """
    n, start, done, out = len(strength) - 1, 0, 0, []
    while done < n:
        end = _longest(strength, limit, pieces, start, done)
        if end is None:  # what is repeated leaves no room for anything new
            start = done
            end = _longest(strength, limit, pieces, start, done)
        out.append((start, end))
        done = end
        if done < n:
            start = _start(strength, end, overlap, start)
    return out


def _longest(strength: np.ndarray, limit: int, pieces: _Pieces, start: int, done: int) -> int | None:
    """The end of a piece from `start` on that reaches beyond `done` and is within the limit by its own encoding; None if there is none."""
    n = len(strength) - 1
    hi = min(start + limit, n)
    while hi > done:
        end = n if hi == n else _strongest(strength, max(done + 1, (start + hi) // 2), hi, hi)
        if end is None:  # within a character; the next whole one before
            hi -= 1
            continue
        over = pieces.own_tokens(start, end) - limit
        if over <= 0:
            return end
        hi = end - max(1, over)
    # Fewer tokens than that may still be too many only if what is beyond `done` is one character.
    whole = np.flatnonzero(strength[done + 1 :] > BROKEN)
    end = done + 1 + int(whole[0])
    return end if start == done or pieces.own_tokens(start, end) <= limit else None


def split_texts(docs: DataFrame, doc_id: str, text: str, limit: int = 512, overlap: int = 64, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id BIGINT, piece_no INT, token_start INT, token_end INT, n_tokens INT, overlap_tokens INT, cut STRING, piece STRING)
    of each text above `limit` tokens: its pieces in order, from 0, as ranges of the text's tokens and as text.

    Every piece has at most `limit` tokens, ends at the end of a paragraph, line, sentence or word where there are any, and
    repeats `overlap` tokens of the one before, or up to a quarter fewer to start at a natural boundary. Together the pieces cover
    the text. cut: the kind of boundary at the piece's end, `none` in texts without any there.

    Texts of at most `limit` tokens, null and empty texts give no row. Every row is split by itself, so a repeated row gives
    repeated pieces; null ids are kept; extra columns don't matter; an empty table gives no rows. One pass
    without a shuffle.
    """
    if not 0 <= overlap < limit // 2 or limit < 8:
        raise ValueError("limit must be 8 or more and overlap less than half of it")

    def run(batches):
        enc = encoder(tokenizer)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = ["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "overlap_tokens", "cut", "piece"]
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # A token has at least one byte, so shorter texts need not be encoded.
                if not t or len(t.encode()) <= limit:
                    continue
                ids = np.array(enc.encode_ordinary(t), np.int64)
                if len(ids) <= limit:
                    continue
                before = 0
                for k, (a, b, kind, piece) in enumerate(split_ids(ids, limit, overlap, tokenizer, t.encode())):
                    rows.append((doc, k, a, b, b - a, max(0, before - a), KINDS[kind], piece.decode("utf-8", "replace")))
                    before = b
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "doc_id bigint, piece_no int, token_start int, token_end int, n_tokens int, overlap_tokens int, cut string, piece string"
    )
