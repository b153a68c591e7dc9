"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined into one text and indexed by a suffix array. Every piece of the vocabulary is
found in it by binary search, which gives all its occurrences at once; these are the edges of the segmentation graph.
Edges are sorted by position and then relaxed. The vocabulary is a byte-pair model, for which the best path is the one
that joins the best-scored neighbours first, so relaxing contracts edges in that order, for all words at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import text_or_empty

VOCABULARY = "piece_bpe_32k"
SPACE = "▁"
CHUNK_CHARS = 1 << 20
WORDS_HELD, CHARS_HELD = 400_000, 4_000_000
LENGTH_BITS = 5  # an edge is its position and its length in one number
END = 0x110000  # between words; no character
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """The vocabulary: code points, scores and ids of its pieces, sorted, and the bytes of every id."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in normal]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("pieces run over word ends")
        self.longest = max(map(len, texts))
        if self.longest >= 1 << LENGTH_BITS:
            raise ValueError(f"a piece of {self.longest} characters; edges hold lengths below {1 << LENGTH_BITS}")
        self.codes = np.full((len(texts), self.longest), -1, dtype=np.int32)
        for row, t in zip(self.codes, texts, strict=True):
            row[: len(t)] = [ord(c) for c in t]
        self.lengths = np.array([len(t) for t in texts])
        self.ids = np.array(normal, dtype=np.int32)
        self.scores = np.array([model.get_score(i) for i in normal])
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.bytes = [b""] * size
        for i, t in zip(normal, texts, strict=True):
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the ``depth`` codes that follow them.

    Codes are numbered densely, so that the first comparison packs as many of them as 63 bits hold; then the compared
    length doubles.
    """
    seen = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    seen[codes] = True
    dense = np.cumsum(seen)[codes]
    bits = int(dense.max(initial=1)).bit_length()
    done = min(depth, 63 // bits)
    key = np.zeros(len(codes), dtype=np.int64)
    for i in range(min(done, len(codes))):
        key[: len(codes) - i] |= dense[i:] << (bits * (done - 1 - i))
    while done < depth:
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        key = rank * (len(rank) + 2)
        key[:-done] += rank[done:]
        done *= 2
    return np.argsort(key)


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes start with it."""
    padded = np.concatenate([codes, np.full(pieces.longest, -1, dtype=codes.dtype)])  # the end sorts first, as in order

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces.ids), dtype=np.int64), np.full(len(pieces.ids), len(order), dtype=np.int64)
        while (todo := low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            less, same = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
            for i in range(pieces.longest):
                within = same & (i < pieces.lengths)
                if not within.any():
                    break
                seen, want = padded[at + i], pieces.codes[:, i]
                less |= within & (seen < want)
                same &= ~within | (seen == want)
            before = todo & (less | (same if upper else False))
            low = np.where(before, middle + 1, low)
            high = np.where(todo & ~before, middle, high)
        return low

    return bound(False), bound(True)


def edges(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(key, piece) of every occurrence, sorted by position and length: key is position << LENGTH_BITS plus length."""
    order = suffix_array(codes, pieces.longest)
    low, high = occurrences(codes, order, pieces)
    many = high - low
    piece = np.repeat(np.arange(len(many)), many)
    at = order[np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    packed = np.sort(((at << LENGTH_BITS) + pieces.lengths[piece]) << 20 | piece)  # at most one piece for a position and length
    return packed >> 20, (packed & ((1 << 20) - 1)).astype(np.int32)


class Relaxation:
    """Contracts the neighbours with the best edge in every word, until no edge is left."""

    def __init__(self, key: np.ndarray, piece: np.ndarray, scores: np.ndarray):
        self.key, self.score = np.append(key, np.iinfo(np.int64).max), np.append(scores[piece], -np.inf)

    def pair(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        wanted = (start << LENGTH_BITS) + length
        at = np.searchsorted(self.key, wanted)
        return np.where((length < 1 << LENGTH_BITS) & (self.key[at] == wanted), self.score[at], -np.inf)

    def run(self, start: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and word of every character, ascending; returns start, end and word of every symbol."""
        end = start + 1
        score = np.full(len(start), -np.inf)
        inside = np.flatnonzero(word[1:] == word[:-1])
        score[inside] = self.pair(start[inside], end[inside + 1])
        done = []
        while len(start):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(start))))
            over = best == -np.inf
            if over.any():
                done.append((start[over], end[over], word[over]))
                start, end, word, score, best = start[~over], end[~over], word[~over], score[~over], best[~over]
                if not len(start):
                    break
            found = np.flatnonzero(score == best)
            chosen = found[self._alternate(found)]
            chosen = chosen[~np.isin(word[chosen], self._upset(chosen, start, end, word, best)) | np.append(True, word[chosen][1:] != word[chosen][:-1])]
            end, keep = end.copy(), np.ones(len(start), dtype=bool)
            end[chosen] = end[chosen + 1]
            keep[chosen + 1] = False
            at = np.cumsum(keep)[chosen] - 1
            start, end, word, score = start[keep], end[keep], word[keep], score[keep]
            score[at] = -np.inf
            for i in (at[(at + 1 < len(start))], at[at > 0] - 1):
                same = i[word[i] == word[i + 1]]
                score[same] = self.pair(start[same], end[same + 1])
        if not done:
            return start, end, word
        start, end, word = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(start)
        return start[by], end[by], word[by]

    @staticmethod
    def _alternate(found: np.ndarray) -> np.ndarray:
        """Of neighbouring pairs, which share a symbol, every other one from the left."""
        new = np.append(True, found[1:] != found[:-1] + 1)
        head = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
        return (np.arange(len(found)) - head) % 2 == 0

    def _upset(self, chosen: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Words where a contraction would give a pair that comes before the next chosen one: they go one by one."""
        many = chosen[np.append(False, word[chosen][1:] == word[chosen][:-1]) | np.append(word[chosen][1:] == word[chosen][:-1], False)]
        if not len(many):
            return np.empty(0, dtype=word.dtype)
        out = [np.empty(0, dtype=word.dtype)]
        right = many[many + 2 < len(start)]
        right = right[word[right + 2] == word[right]]
        out.append(word[right[self.pair(start[right], end[right + 2]) > best[right]]])
        left = many[many > 0]
        left = left[word[left - 1] == word[left]]
        behind = np.where(np.isin(left - 2, many) & (left > 1), left - 2, left - 1)
        out.append(word[left[np.maximum(self.pair(start[behind], end[left + 1]), self.pair(start[left - 1], end[left + 1])) > best[left]]])
        return np.unique(np.concatenate(out))


class Encoder:
    """Ids of texts; words met before are kept, up to WORDS_HELD of them and CHARS_HELD characters."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.pieces = Pieces(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(0, dtype=np.int32)
        self.offsets = np.zeros(1, dtype=np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words without their leading mark."""
        flat, counts, at = [], [], 0
        while at < len(texts):
            held, to = 0, at
            while to < len(texts) and (to == at or held + len(texts[to]) + 2 <= CHUNK_CHARS):
                held += len(texts[to]) + 2
                to += 1
            ids, n = self._chunk(texts[at:to])
            flat.append(ids)
            counts.append(n)
            at = to
        return np.concatenate(flat), np.concatenate(counts)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("\n".join([SPACE + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<i4").copy()
        lengths = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(lengths + 1) - lengths - 1
        ends = first[1:] - 1
        codes[ends] = END
        inner = np.ones(len(codes), dtype=bool)
        inner[ends] = False
        start = np.flatnonzero(inner)
        key, piece = edges(codes, self.pieces)
        relaxed = Relaxation(key, piece, self.pieces.scores)
        s, e, w = relaxed.run(start, np.repeat(np.arange(len(texts)), lengths))
        wanted = (s << LENGTH_BITS) + (e - s)
        at = np.searchsorted(relaxed.key, wanted)
        known = relaxed.key[at] == wanted
        ids = np.full(len(s), -1, dtype=np.int32)
        ids[known] = self.pieces.ids[piece[at[known]]]
        size = np.ones(len(s), dtype=np.int64)
        strange = np.flatnonzero(~known)
        spelt = [self.pieces.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in codes[s[strange]]]
        if len(strange):
            size[strange] = [len(x) for x in spelt]
            out = np.repeat(ids, size)
            out[np.repeat(~known, size)] = np.concatenate(spelt)
            ids = out
        return ids, np.bincount(w, weights=size, minlength=len(texts)).astype(np.int64)

    @staticmethod
    def split(text: str) -> list[str]:
        """Words without their leading mark; none for an empty text."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.known) > WORDS_HELD or self.chars > CHARS_HELD:
            self._clear()
        new = list(set().union(*split).difference(self.known))
        if new:
            ids, counts = self.words(new)
            self.chars += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        out = []
        for words in split:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            many = self.offsets[at + 1] - self.offsets[at]
            place = np.arange(many.sum()) + np.repeat(self.offsets[at] - np.cumsum(many) + many, many)
            out.append(self.ids[place])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the mark in front of it."""
        data = b"".join(map(self.pieces.bytes.__getitem__, ids.tolist()))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


CHUNK_TEXT = 4_000_000


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip and, with ``with_ids``, ids of every row.

    ids are those of the vocabulary's own encoder. round_trip tells whether decoding them gives the text again (with a
    space for each character that the vocabulary itself uses as its mark). A null or empty text has no ids; a null
    doc_id is kept; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            doc_ids, held, texts = batch.column(0), 0, []
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py())
                held += len(texts[-1])
                if held >= CHUNK_TEXT or i == batch.num_rows - 1:
                    ids = encoder.encode(texts)
                    decoded = [encoder.decode(x) for x in ids]
                    columns = [
                        doc_ids.slice(i + 1 - len(texts), len(texts)),
                        pa.array([len(x) for x in ids], type=pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], type=pa.int64()),
                        pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded], type=pa.string()),
                        pa.array([d == t.replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)], type=pa.bool_()),
                    ] + [pa.array(ids, type=pa.list_(pa.int32()))] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, names)
                    held, texts = 0, []

    fields = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, fields)
