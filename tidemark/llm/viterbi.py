"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut before each run of spaces; no piece reaches over such a cut.  The distinct words of a block of
texts are sorted by length and those of equal length advance together: hashes of all substrings that start
at a position probe the sorted hashes of the pieces, and the maxima of score so far keep the piece that led
to them.  A word of more than `LONG` characters is cut alone: its pieces are found for all positions at once, and
only the maxima go from position to position.  Characters that no piece covers fall back to the bytes of their UTF-8.

The vocabulary is a file's; nothing is trained.  Segmentation maximises the sum of the file's piece scores
(the unigram rule).  A literal U+2581 in a text, which stands for a space inside pieces, also falls back to
bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.store import documents_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE, _LITERAL = 0x2581, 0x110000
LONG = 256  # longer words (unspaced scripts, encoded data) are few of one length
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_SALT = _U(0xD6E8FEB86659FD93)
_LOW = _U((1 << 20) - 1)


def _salt(size: int) -> int:
    return size * int(_SALT) % (1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _code(points: np.ndarray) -> np.ndarray:
    return K.mix(points.astype(np.uint64) + _U(0x632BE59BD9B4E019))


@dataclass
class Vocabulary:
    """Pieces by id: bytes (spaces already in place of U+2581), scores; sorted hashes of those that can be matched."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    unknown_score: float
    byte_ids: np.ndarray
    longest: int
    bytes_: np.ndarray
    offsets: np.ndarray

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        return cls.of(sentencepiece.SentencePieceProcessor(model_file=path))

    @classmethod
    def of(cls, model) -> Vocabulary:
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain, byte_ids, raw = [], np.full(256, model.unk_id()), []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {i} reaches over a space")
                plain.append(i)
                raw.append(piece.replace("▁", " ").encode())
        hashes = np.array([_hash_of(pieces[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        scores = np.array([model.get_score(i) for i in plain])[order]
        ends = np.cumsum([0, *map(len, raw)])
        return cls(hashes[order], np.array(plain)[order], scores, float(scores.min()) - 10, byte_ids, max(len(pieces[i]) for i in plain), np.frombuffer(b"".join(raw), dtype=np.uint8), ends)

    def __post_init__(self) -> None:
        self.hint = np.zeros(1 << 20, dtype=bool)  # by the low bits of a hash: may it be a piece's?
        self.hint[self.keys & _LOW] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index among the sorted keys, -1 for what is no piece; few hashes get past the hint to the search."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.hint[h & _LOW])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        good = self.keys[at] == h[maybe]
        out[maybe[good]] = at[good]
        return out


def _hash_of(piece: str) -> int:
    points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
    return (int((_code(points) * _powers(_B, len(points))).sum()) + _salt(len(points))) % (1 << 64)


def _viterbi(points: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of equal length (rows of code points): (row, value) in order; values below 0 are -1 - code point."""
    n, length = points.shape
    sums = np.zeros((n, length + 1), dtype=np.uint64)
    np.cumsum(_code(points) * _powers(_B, length), axis=1, out=sums[:, 1:])
    down = _powers(_INV, length)
    best, back, width = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), dtype=np.int64), np.ones((n, length + 1), dtype=np.int64)
    best[:, 0] = 0
    for i in range(length):
        for size in range(1, min(vocabulary.longest, length - i) + 1):
            at = vocabulary.find((sums[:, i + size] - sums[:, i]) * down[i] + _U(_salt(size)))
            rows = np.arange(n) if size == 1 else np.flatnonzero(at >= 0)  # a single character always leads on
            if not len(rows):
                continue
            at = at[rows]
            score = np.where(at >= 0, vocabulary.scores[at], vocabulary.unknown_score) + best[rows, i]
            better = score > best[rows, i + size]
            rows, at = rows[better], at[better]
            best[rows, i + size] = score[better]
            back[rows, i + size] = np.where(at >= 0, vocabulary.ids[at], -1 - points[rows, i].astype(np.int64))
            width[rows, i + size] = size
    row, at, out_row, out_value = np.arange(n), np.full(n, length), [], []
    while len(row):
        out_row.append(row)
        out_value.append(back[row, at])
        at = at - width[row, at]
        row, at = row[at > 0], at[at > 0]
    rows, values = np.concatenate(out_row)[::-1], np.concatenate(out_value)[::-1]
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def _viterbi_long(points: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The values for one long word, as `_viterbi` gives them: its pieces are found for all positions at once."""
    length = len(points)
    sums, down = np.zeros(length + 1, dtype=np.uint64), _powers(_INV, length)
    np.cumsum(_code(points) * _powers(_B, length), out=sums[1:])
    ends, sizes, found = [], [], []
    for size in range(min(vocabulary.longest, length), 0, -1):
        at = vocabulary.find((sums[size:] - sums[:-size]) * down[: length - size + 1] + _U(_salt(size)))
        rows = np.arange(length) if size == 1 else np.flatnonzero(at >= 0)
        ends.append(rows + size)
        sizes.append(np.full(len(rows), size))
        found.append(at[rows])
    end, size, at = (np.concatenate(x) for x in (ends, sizes, found))
    order = np.argsort(end, kind="stable")  # longer pieces first, as they start earlier
    score = np.where(at >= 0, vocabulary.scores[at], vocabulary.unknown_score)[order].tolist()
    value = np.where(at >= 0, vocabulary.ids[at], -1 - points[end - size].astype(np.int64))[order].tolist()
    size, cut = size[order].tolist(), np.searchsorted(end[order], np.arange(1, length + 2)).tolist()
    best, back = [0.0] * (length + 1), [0] * (length + 1)
    for i in range(1, length + 1):
        top = -np.inf
        for k in range(cut[i - 1], cut[i]):
            total = best[i - size[k]] + score[k]
            if total > top:
                top, back[i] = total, k
        best[i] = top
    out, i = [], length
    while i:
        out.append(value[back[i]])
        i -= size[back[i]]
    return np.array(out[::-1], dtype=np.int64)


def _as_bytes(values: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with code points (values below 0) spelt as byte pieces, and how many ids each value became."""
    point = np.where(values < 0, -1 - values, 0)
    point[point == _LITERAL] = _SPACE
    size = np.where(values >= 0, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
    of = np.repeat(np.arange(len(values)), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    p, s = point[of], size[of]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[s]
    byte = np.where(k == 0, lead | p >> 6 * (s - 1), 0x80 | p >> 6 * (s - 1 - k) & 0x3F)
    return np.where(values[of] >= 0, values[of], byte_ids[byte & 0xFF]), size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of the runs start[i] .. start[i] + size[i] - 1, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encode(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, offsets of each text's, and its characters that fell back to bytes."""
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    joined = "".join(" " + t if t else "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    points[points == _SPACE] = _LITERAL
    points[points == 32] = _SPACE
    offsets = np.r_[0, np.cumsum(lengths)]
    if not len(points):
        return np.zeros(0, dtype=np.int64), offsets, np.zeros(len(texts), dtype=np.int64)
    space = points == _SPACE
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][lengths > 0]] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.r_[start, len(points)])
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_code(points) * _powers(_B, len(points)), out=sums[1:])
    key = (sums[start + size] - sums[start]) * _powers(_INV, len(points))[start] + size.astype(np.uint64) * _SALT
    _, first, word = np.unique(key, return_index=True, return_inverse=True)
    rows, values = [], []
    order = np.argsort(size[first], kind="stable")
    cuts = np.flatnonzero(np.diff(size[first][order], prepend=-1))
    for group in np.split(order, cuts[1:]):
        width = int(size[first[group[0]]])
        if width > LONG:
            for k in group.tolist():
                values.append(_viterbi_long(points[start[first[k]] : start[first[k]] + width], vocabulary))
                rows.append(np.full(len(values[-1]), k))
            continue
        for part in np.array_split(group, -(-len(group) * width // (1 << 18))):
            r, v = _viterbi(points[start[first[part]][:, None] + np.arange(width)], vocabulary)
            rows.append(part[r])
            values.append(v)
    rows, values = np.concatenate(rows), np.concatenate(values)
    by_word = np.argsort(rows, kind="stable")
    rows, values = rows[by_word], values[by_word]
    ids, spelt = _as_bytes(values, vocabulary.byte_ids)
    per_word = np.bincount(rows, weights=spelt, minlength=len(first)).astype(np.int64)
    fell = np.bincount(rows[values < 0], minlength=len(first))
    at = np.cumsum(per_word) - per_word
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(text, weights=per_word[word], minlength=len(texts)).astype(np.int64)
    return ids[_spread(at[word], per_word[word])], np.r_[0, np.cumsum(count)], np.bincount(text, weights=fell[word], minlength=len(texts)).astype(np.int64)


def decode(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 of each text, from ids one behind the other."""
    size = np.diff(vocabulary.offsets)[ids]
    data = vocabulary.bytes_[_spread(vocabulary.offsets[ids], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][offsets]
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoded(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """The input rows with ids array<int>, n_ids, n_fallback and decoded_ok (decoding gives the text again).

    Columns that have these names already are replaced.
    """
    docs = docs.drop("ids", "n_ids", "n_fallback", "decoded_ok")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = [*docs.columns, "ids", "n_ids", "n_fallback", "decoded_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            _, offsets = K.text_buffer(batch.column("text"))
            for a, b in K.row_blocks(offsets):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, at, fell = encode(texts, vocabulary)
                back = decode(ids, at, vocabulary)
                good = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(back, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(at)), pa.array(fell), pa.array(good)], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "ids array<int>, n_ids long, n_fallback long, decoded_ok boolean"]))


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_ids, n_fallback, ids_sha256 (of the ids in decimal, comma-joined), decoded_ok of every row.

    A null or empty text has no ids; repeated rows are repeated; other columns are ignored; an empty table gives no rows.
    """
    out = encoded(documents_of(docs), model)
    return out.select("doc_id", "n_ids", "n_fallback", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "decoded_ok")
