"""Whole-text tokenizing through the tokenizers library, one pre-token group at a time.

Byte-pair merges never cross a pre-token, so a text's ids are its pieces' ids in
order. Texts are cut at white space that is a pre-token boundary for sure, the
library encodes the distinct pieces of a batch, and a text's ids are gathered
from those. A text with unusual white space is encoded whole.

Most pieces are a plain word, or one with punctuation behind it, which is a
pre-token of its own. Normalizing changes nothing but the case of a plain word
and pre-tokenizing leaves it in one piece, so the library encodes many plain
words in one string with both steps left out. Words are kept for the worker's
later batches, up to a number of bytes. Other pieces are encoded many to a
string, with a special token between them: the library cuts texts at special
tokens before it does anything else.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a worker's words and their ids may take before a batch; beyond it they start anew, which changes no result.
CACHE_BYTES = 32 << 20
#: Pieces in a string that the library encodes.
JOINED = 256
#: Text that is cut into pieces at a time; one longer text is cut alone.
BATCH_BYTES = 4 << 20
#: Texts whose ids are gathered together.
TEXTS = 512
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation without the apostrophe, which can start a pre-token with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = rf"^[{_LETTERS}]+[!-&(-/:-@\[-`{{-~]*$"
#: White space other than single spaces and line ends between words.
_UNUSUAL = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that try whether the two steps can be left out.
_PROBES = ["a", "the", "straße", "élève", "niño", "internationalization", "þýðing", "xqzjk"]

Ragged = tuple[np.ndarray, np.ndarray]  # all ids, and where each entry's start, with the end last


def _ragged(parts: list[np.ndarray]) -> Ragged:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")), ends


def _joined(*several: Ragged) -> Ragged:
    """The entries of several, one after the other."""
    at = np.cumsum([0, *(len(ids) for ids, _ in several)])
    return np.concatenate([ids for ids, _ in several]), np.concatenate([[0], *(ends[1:] + a for (_, ends), a in zip(several, at))])


def _gather(pool: Ragged, which: np.ndarray) -> Ragged:
    """Entries ``which`` of the pool, in that order."""
    start = pool[1][which]
    size = pool[1][which + 1] - start
    ends = np.concatenate([[0], np.cumsum(size)])
    return pool[0][np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


class WordPool:
    """Words and their ids, in flat arrays. When they take more than ``limit`` bytes, all but the newest are let go.

    A word is found by its 64-bit hash and then compared itself.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.words, self.known = pa.array([], pa.string()), _ragged([])

    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.at, self.words, *self.known))

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the pool, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1, dtype=np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[near] == hashes, self.at[near], -1).astype(np.int64)
        same = pc.equal(words, self.words.take(pa.array(np.maximum(place, 0)))).to_numpy(zero_copy_only=False)
        return np.where(same, place, -1)

    def of(self, words: pa.Array, encode: Callable[[list[str]], Ragged]) -> Ragged:
        """Ids of each of distinct ``words``; ``encode`` makes those of new ones."""
        listed = words.to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(hash, listed), dtype=np.int64, count=len(listed))
        if self.size() > self.limit:
            self.clear()
        place = self._find(words, hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            n = len(self.words)
            self.known = _joined(self.known, encode(listed[new].tolist()))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
            place[new] = n + np.arange(len(new))
            order = new[np.argsort(hashes[new], kind="stable")]
            spot = np.searchsorted(self.hashes, hashes[order])
            self.hashes, self.at = np.insert(self.hashes, spot, hashes[order]), np.insert(self.at, spot, place[order])
        return _gather(self.known, place)


class PieceCodec:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        # Spark runs a task on each core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = self._separator()
        one, other = (self._encode([t])[0].tolist() for t in ("a b", "a\n \tb"))
        self.by_word = one == other  # white space between words is ignored
        self.bare, self.comma = self._without_steps(Tokenizer(self.tokenizer.model))  # one vocabulary serves both
        self.line_end = self._encode(["\n"])
        self.words = WordPool(cache_bytes)

    def _separator(self) -> tuple[str, int]:
        """A special token that takes nothing from the text beside it; ("", -1) without any."""
        for number, token in sorted(self.tokenizer.get_added_tokens_decoder().items()):
            if token.special and not (token.lstrip or token.rstrip or token.single_word or token.normalized):
                return token.content, number
        return "", -1

    def _without_steps(self, bare):
        """``bare`` without normalizing and with words at line ends, and its id of a comma; (None, -1) if the probes differ."""
        from tokenizers import normalizers, pre_tokenizers

        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        comma = bare.encode(",", add_special_tokens=False).ids
        words = _PROBES if self.by_word else _PROBES + [" " + p for p in _PROBES]
        same = all(bare.encode(w, add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids for w in words)
        return (bare, comma[0]) if same and len(comma) == 1 else (None, -1)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, tokenizer, pieces: list[str], mark: str, mark_id: int) -> Ragged:
        parts = []
        for i in range(0, len(pieces), JOINED):
            some = pieces[i : i + JOINED]
            ids = np.asarray(tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == mark_id)
            if len(cut) != len(some) - 1:
                raise RuntimeError("a piece holds the separator")
            ends = np.concatenate([cut - np.arange(len(cut)), [len(ids) - len(cut)]])
            parts.append((np.delete(ids, cut), np.concatenate([[0], ends])))
        return _joined(*parts) if parts else _ragged([])

    def _encode_pieces(self, pieces: list[str]) -> Ragged:
        return self._encode_joined(self.tokenizer, pieces, self.mark, self.mark_id) if self.mark else _ragged(self._encode(pieces))

    def _of_words(self, words: pa.Array) -> Ragged:
        """Ids of distinct plain words, each with the space before it if one belongs to it."""
        return self.words.of(words, lambda new: self._encode_joined(self.bare, new, "\n,\n", self.comma))

    def _of_pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces; byte-level ones start with NUL or a line end, or stand for a space and the piece."""
        plain = pc.match_substring_regex(pieces if self.by_word else pc.utf8_ltrim(pieces, "\0\n"), _PLAIN) if self.bare else pa.array(np.zeros(len(pieces), dtype=bool))
        other = pieces.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        pool_other = self._encode_pieces(other if self.by_word else [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in other])
        simple = pieces.filter(plain)
        body = simple if self.by_word else pc.utf8_ltrim(simple, "\0\n")
        tails = pc.replace_substring_regex(body, f"^[{_LETTERS}]+", "").dictionary_encode()
        words = pc.utf8_rtrim(body, _MARKS)
        line_end = np.zeros(len(simple), dtype=np.int64)
        if self.by_word:
            words = pc.utf8_lower(words)
        else:
            line_end = pc.starts_with(simple, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
            spaced = pc.equal(pc.binary_length(simple), pc.binary_length(body))
            words = pc.binary_join_element_wise(pc.if_else(spaced, " ", ""), words, "")
        words = words.dictionary_encode()
        # The pool: nothing, a line end, the punctuation, the words. A piece is three of its entries.
        pool = _joined(_ragged([np.zeros(0, dtype="<u4"), *self.line_end]), _ragged(self._encode(tails.dictionary.to_pylist())), self._of_words(words.dictionary))
        three = np.stack([line_end, 2 + len(tails.dictionary) + words.indices.to_numpy().astype(np.int64), 2 + tails.indices.to_numpy().astype(np.int64)], axis=1)
        ids, ends = _gather(pool, three.ravel())
        order = np.empty(len(pieces), dtype=np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        order[mask], order[~mask] = np.arange(len(simple)), len(simple) + np.arange(len(other))
        return _gather(_joined((ids, ends[::3]), pool_other), order)

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text in order; null counts as empty. About ``BATCH_BYTES`` of text are held as pieces at a time."""
        texts = texts.cast(pa.string())
        turn = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:]):
            yield from self._ids(pc.fill_null(texts.slice(a, b - a), ""))
            pa.default_memory_pool().release_unused()

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring(texts, self.mark) if self.mark else pa.array(np.zeros(len(texts), dtype=bool))
        if not self.by_word:
            whole = pc.or_(whole, pc.match_substring_regex(texts, _UNUSUAL))
        rest = pc.if_else(whole, "", texts)
        if self.by_word:
            rest = pc.replace_substring(rest, "\n", " ")
        else:
            rest = pc.binary_join_element_wise("\0", pc.replace_substring(rest, "\n", " \n"), "")
        cut = pc.split_pattern(rest, " ")
        coded = cut.values.dictionary_encode()
        at, which, alone = cut.offsets.to_numpy(), coded.indices.to_numpy(), whole.to_numpy(zero_copy_only=False)
        pool = self._of_pieces(coded.dictionary)
        for i in range(0, len(texts), TEXTS):
            edges = at[i : i + TEXTS + 1]
            ids, ends = _gather(pool, which[edges[0] : edges[-1]])
            ends = ends[edges - edges[0]]
            for k in range(len(edges) - 1):
                yield (self._encode([texts[i + k].as_py()])[0] if alone[i + k] else ids[ends[k] : ends[k + 1]]).tobytes()


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec, which keeps its words for later tasks."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
