"""Byte-pair encoding by backtracking, and decoding by an offset table.

The merges of a word are found without merging: an Aho-Corasick automaton lists the tokens
that start at each position, the longest is tried first, and a token may follow another if
their pair is *compatible*, that is, if merging their joined text would never cross the
boundary between them. When nothing fits, the last token gives way to a shorter one, and the
position it led to is closed for good, so a word takes time linear in its length.

Words never span white space, so a text is cut there and each worker remembers the ids of the
pieces it met, up to twice CACHE_PIECES of them.

* null text counts as empty and has no ids; empty ids decode to an empty text.
* repeated rows are encoded like all others; extra columns stay, and the result columns
  replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quorum.llm.common import map_batches

CACHE_PIECES = 400_000
#: Pieces looked up together, by which a long text may exceed the caches.
SLICE_PIECES = 50_000
#: Longer pieces are encoded but not remembered.
CACHE_PIECE_BYTES = 64
#: Ids decoded by one gather.
DECODE_IDS = 1 << 16
#: Letters from here on are split and put in lower case by the tokenizer's own tables, whose
#: Unicode version is not Python's; below, both agree.
LATIN_END = "\u0250"
#: Stands for a symbol that also carries the end of the word.
END_SHIFT = 0x400

# The white space and the word pattern of the tokenizer's definition.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same of ASCII text in lower case, which the plain module matches faster.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else a letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """A bounded cache of ``make``. When it is full its entries become the old half, from which
    they come back when they are asked for again; the rest is forgotten at the next turn."""

    def __init__(self, make, half: int = CACHE_PIECES):
        super().__init__()
        self.make, self.half, self.old = make, half, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_PIECE_BYTES:
                return value
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()


BYTE_MAP = dict(enumerate(byte_symbols()))


def latin_words(text: str) -> list[str]:
    """The words of a text of Latin letters in lower case, each spelled in byte symbols."""
    if text.isascii():
        words = ASCII_WORDS(text.lower())
        return words if text.isprintable() else [w.translate(BYTE_MAP) for w in words]
    words = WORD.findall(unicodedata.normalize("NFC", text).lower())
    return [w.encode().decode("latin-1").translate(BYTE_MAP) for w in words]


class BpeTables:
    """Tokens, merges and the automaton of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = {i: -1 for i in vocab.values()}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            left, right = vocab[a], vocab[b]
            if whole in self.parts:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.merged[left, right] = rank
            self.parts[whole] = (left, right)
            self.born[whole] = rank
        self.length: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            symbols = self.symbols(token)
            self.length[i] = len(symbols)
            if self.reachable(i):
                # Reversed: a match that ends somewhere is then a token that starts there.
                self.automaton.add_word(symbols[::-1], i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Remembered(self.encode_word)
        self.library = Tokenizer.from_file(path)

    def symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END_SHIFT)
        return token

    def _crosses(self, left: int, right: int, limit_left: float, limit_right: float) -> bool:
        """Whether a merge across the boundary comes before the merges that hide both sides.

        The pieces at the boundary are taken apart in the reverse order of their making. Equal
        ranks are made from left to right, hence the two different comparisons.
        """
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit_left and rank <= limit_right:
                return True
            if self.born[left] > self.born[right]:
                limit_left = self.born[left]
                left = self.parts[left][1]
            elif right in self.parts:
                limit_right = self.born[right]
                right = self.parts[right][0]
            else:
                return False

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own text makes the token."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        born = self.born[token]
        return self.reachable(left) and self.reachable(right) and not self._crosses(left, right, born, born - 1)

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = not self._crosses(left, right, float("inf"), float("inf"))
            if len(self.pairs) < 1_000_000:
                self.pairs[left, right] = known
        return known

    def encode_symbols(self, symbols: str) -> list[int]:
        """The ids of one word."""
        whole = self.automaton.get(symbols[::-1], None)
        if whole is not None:
            return [whole]
        n = len(symbols)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(symbols[::-1]):
            starts[n - 1 - end].append(token)
        length, compatible = self.length, self.compatible
        for tokens in starts:
            tokens.sort(key=length.__getitem__)
        closed = [False] * (n + 1)
        out: list[int] = []
        at = 0
        while at < n:
            if starts[at]:
                token = starts[at][-1]
                end = at + length[token]
                if not closed[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = end
                else:
                    starts[at].pop()
                continue
            if not out:
                raise ValueError(f"no tokens for {symbols!r}")
            closed[at] = True
            # Whatever follows was tried against the token that now goes.
            at -= length[out.pop()]
            starts[at].pop()
        return out

    def encode_piece(self, text: str) -> bytes:
        """The ids of a text without white space at which it could be cut."""
        ids: list[bytes] = []
        for part in self.special.split(text) if self.special and self.special.search(text) else [text]:
            if part in self.specials:
                ids.append(id_bytes([self.specials[part]]))
                continue
            self.words.turn()
            ids += map(self.words.__getitem__, self.split_words(part))
        return b"".join(ids)

    def encode_word(self, word: str) -> bytes:
        return id_bytes(self.encode_symbols(self.symbols(word + self.suffix)))

    def split_words(self, text: str) -> list[str]:
        """The words of a text in lower case, each spelled in byte symbols."""
        if max(text, default="") >= LATIN_END:
            text = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return latin_words(text)


class OffsetTable:
    """The spellings of all ids end to end, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = token.encode() + b" "
        self.spelled_length = np.array([len(s) for s in spelled], np.int64)
        self.spelled_start = np.concatenate([[0], np.cumsum(self.spelled_length)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> str:
        """The tokens of the ids, one space between, gathered from the offset table."""
        out = []
        for i in range(0, len(ids), DECODE_IDS):
            part = ids[i : i + DECODE_IDS]
            lengths = self.spelled_length[part]
            before = np.cumsum(lengths) - lengths
            at = np.repeat(self.spelled_start[part] - before, lengths)
            at += np.arange(len(at))
            out.append(self.spelling[at].tobytes())
        return b"".join(out)[:-1].decode()


class PieceCache:
    """Ids of a text, as little-endian unsigned 32-bit bytes, from those of its pieces between
    ASCII white space; ``encode`` gives the bytes of a piece."""

    def __init__(self, encode):
        self.known = Remembered(lambda piece: encode(piece.decode()))

    def __call__(self, text: str | None) -> bytes:
        pieces = (text or "").encode().split()
        if len(pieces) <= SLICE_PIECES:
            return self._slice(pieces)
        return b"".join(self._slice(pieces[i : i + SLICE_PIECES]) for i in range(0, len(pieces), SLICE_PIECES))

    def _slice(self, pieces: list[bytes]) -> bytes:
        self.known.turn()
        return b"".join(map(self.known.__getitem__, pieces))


#: By file, once per worker.
_CACHES: dict[str, PieceCache] = {}
_OFFSETS: dict[str, OffsetTable] = {}


def encode(docs: DataFrame, path: str, output: str = "tokens") -> DataFrame:
    """``docs(text)`` with the ids of every whole text as ``array<int>``."""
    docs = docs.drop(output)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        if path not in _CACHES:
            bpe = BpeTables(path)
            _CACHES[path] = PieceCache(bpe.encode_piece)
        ids_of = _CACHES[path]
        for batch in batches:
            encoded = [ids_of(t.as_py()) for t in batch.column(at)]
            offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)])
            values = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, output])

    return map_batches(docs, run, schema)


def decode(docs: DataFrame, path: str, tokens: str = "tokens", output: str = "decoded") -> DataFrame:
    """``docs`` with the text its ids stand for. Null ids decode to an empty text."""
    docs = docs.drop(output)
    at = docs.columns.index(tokens)
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.StringType(), False)])

    def run(batches):
        if path not in _OFFSETS:
            _OFFSETS[path] = OffsetTable(path)
        table = _OFFSETS[path]
        for batch in batches:
            column = batch.column(at)
            values = column.values.to_numpy(zero_copy_only=False)
            bounds = column.offsets.to_numpy()
            texts = [table.spell(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts)], [*batch.schema.names, output])

    return map_batches(docs, run, schema)
