"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are escaped (dummy prefix, space to U+2581) and cut before each run of
U+2581; no piece of such a model crosses that cut, which is checked when the model is
read, so words are encoded one by one. The words of a batch that are not remembered
lie in flat numpy arrays: a symbol for each character, a rank for each pair. A round
takes the least rank of every word (segmented minimum), merges the leftmost pair of
that rank in all words at once, compacts the arrays and looks up only the pairs
beside a merge; words without a pair leave. One merge a word and round keeps the
library's order (best score first, then leftmost). Words of over ``LONG`` characters
use a heap with the same order, so a text without spaces stays near-linear.

Characters that are no piece become byte pieces. Decoding joins the bytes of pieces,
U+2581 as a space, and takes away the prefix.

Plan: no shuffle, one Arrow map; memory is a batch and a bounded table of words.

Defined results: null = empty text = begin and end ids alone, decoded to the empty
text; a null doc_id is kept as null; a very long text is encoded as a whole; an empty
table gives no rows; repeated rows give repeated rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_of

GAP = "▁"
LONG = 400
_REMEMBER = 250_000
_WORDS = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")
_NONE = np.int64(1 << 40)
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """A BPE model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kind.model_type != 2 or not kind.byte_fallback:
            raise ValueError("this codec reads BPE models with identity normaliser, dummy prefix and byte fallback")
        self.begin, self.end, self.unknown = kind.bos_id, kind.eos_id, kind.unk_id
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if any(k in (USER_DEFINED, UNUSED) for k in kinds):
            raise ValueError("user-defined and unused pieces are not known here")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any(GAP in p.lstrip(GAP) for p in self.id_of):
            raise ValueError("a piece spans two words")
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of = [p.replace(GAP, " ").encode() for p in self.pieces]
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                b = int(p[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif kinds[i] != NORMAL:
                self.bytes_of[i] = b""
        # Symbols: pieces by id, then characters that occur in pieces only.
        self.symbol_of = dict(self.id_of)
        for p in self.id_of:
            for c in p:
                self.symbol_of.setdefault(c, len(self.pieces) + len(self.symbol_of))
        self.width = 1 + max(self.symbol_of.values(), default=0)
        score = {i: model.pieces[i].score for i in self.id_of.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.symbol_of.get(p[:k]), self.symbol_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (rank_of[score[i]] << 20) | i  # rank and merged piece in one number
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        points = sorted(c for c in self.symbol_of if len(c) == 1)
        self.points = np.array([ord(c) for c in points], np.int64)
        self.point_symbols = np.array([self.symbol_of[c] for c in points], np.int64)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece of pairs; _NONE where no piece is made. Foreign characters are negative."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        return np.where(self.points[at] == points, self.point_symbols[at], -1 - points)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word after all merges, all words together."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        sym = self._symbols(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64))
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start) >> 20
            done = least == _NONE >> 20
            if done.any():
                for s, n in zip(start[done].tolist(), size[done].tolist(), strict=True):
                    out[word[s]] = sym[s : s + n]
                stay = np.repeat(~done, size)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                size, least = size[~done], least[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank >> 20 == np.repeat(least, size))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            sym[at] = rank[at] & 0xFFFFF
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            right = at[at + 1 < len(sym)]
            right = right[word[right] == word[right + 1]]
            rank[at] = _NONE
            rank[right] = self._rank(sym[right], sym[right + 1])
            left = at[at > 0]
            left = left[word[left] == word[left - 1]]
            rank[left - 1] = self._rank(sym[left - 1], sym[left])
        return out

    def encode_long(self, word: str) -> np.ndarray:
        """The same merges by a heap of pairs (rank, place)."""
        sym = self._symbols(np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)).tolist()
        n, pairs, width = len(sym), self.pairs, self.width
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def add(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (v := pairs.get(sym[i] * width + sym[j])) is not None:
                heapq.heappush(heap, (v >> 20, i, sym[i], sym[j]))

        for i in range(n - 1):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = pairs[a * width + b] & 0xFFFFF, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(i)
            if before[i] >= 0:
                add(before[i])
        return np.array([s for s in sym if s is not None], np.int64)

    def _ids(self, symbols: np.ndarray) -> bytes:
        """Ids as bytes; symbols that are no piece as byte pieces."""
        foreign = (symbols < 0) | (symbols >= len(self.pieces))
        if foreign.any():
            out: list[int] = []
            for s in symbols.tolist():
                if 0 <= s < len(self.pieces):
                    out.append(s)
                else:
                    c = chr(-1 - s) if s < 0 else next(c for c, k in self.symbol_of.items() if k == s)
                    out += self.byte_id[list(c.encode())].tolist()
            symbols = np.array(out, np.int64)
        return symbols.astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, with begin and end."""
        split = [_WORDS.findall(GAP + t.replace(" ", GAP)) if t else [] for t in texts]
        missing = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.known]
        found = self.known if len(self.known) + len(missing) <= _REMEMBER else dict.fromkeys(missing)
        short = [w for w in missing if len(w) <= LONG]
        for i in range(0, len(short), 100_000):
            part = short[i : i + 100_000]
            found.update(zip(part, map(self._ids, self.encode_words(part)), strict=True))
        found.update((w, self._ids(self.encode_long(w))) for w in missing if len(w) > LONG)
        if found is self.known:
            get = found.__getitem__
        else:
            known = self.known

            def get(w: str) -> bytes:
                return known.get(w) or found[w]

        begin, end = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [np.frombuffer(b"".join([begin, *map(get, ws), end]), "<u4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


_codec: PieceCodec | None = None


def codec() -> PieceCodec:
    """One codec a worker."""
    global _codec
    if _codec is None:
        _codec = PieceCodec()
    return _codec


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                ids = c.encode_batch(b.column(1).to_pylist())
                columns = [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
