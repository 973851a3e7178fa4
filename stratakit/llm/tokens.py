"""Encoding with a public tokenizer file, with a cache of words.

The tokenizer used here drops white space and never joins across it, so a
text's ids are the ids of its white-space-separated words, one after another.
Most words of a corpus come again and again; each is encoded once per cache.
"""

from __future__ import annotations

import ctypes
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in one worker's cache. It has two halves: a full young one
#: becomes the old one, and what the old one is not asked for again is dropped.
CACHE_WORDS = 1_000_000
#: Texts of 512 words handed to the tokenizer at once; its results take some
#: hundred bytes a token until they are copied.
ENCODE_PARTS = 16
#: Letters before this character are in normal form by themselves.
LAST_PLAIN = "\u0250"
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))


def word_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _shown_bytes() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: printable ones as they
    are, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


SHOWN = _shown_bytes()


def _plain(low: str) -> bool:
    """Letters that stay as they are under normal form and lower case."""
    return low.isalpha() and max(low) < LAST_PLAIN


def ids_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordEncoder:
    """``encode(texts)`` gives one little-endian unsigned 32-bit array a text,
    equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Only ASCII white space separates cached words (the tokenizer breaks there
    under any rule); other white space stays inside a word and is left to the
    tokenizer itself.  Two more facts of this tokenizer raise the hit rate: it
    lower-cases, and a mark after a letter starts a piece of its own.
    """

    def __init__(self, path: str, max_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.max_words = max_words
        self.known: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def trim(self) -> None:
        """Empty the cache and give free memory back: a worker that waits for
        its next task keeps the tokenizer only."""
        self.known, self.old = {b"": b""}, {}
        pa.default_memory_pool().release_unused()
        release = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
        if release:
            release(0)

    def _add(self, words: set[bytes]) -> None:
        """Encode new words: plain ones by the tokenizer's model itself, the
        others as few texts, set apart by a mark that has an id of its own and
        is in none of them."""
        known, mark, encode = self.known, self.mark, self.tokenizer.encode_batch_fast
        model, rest = self.tokenizer.model.tokenize, []
        for w in words:
            text = w.decode()
            low = text.lower()
            # One piece of letters, in normal form: lower case, then bytes
            # written as characters, is all that is done before the model.
            if w.isalpha():                                # of bytes: ASCII letters only
                known[w] = ids_bytes([t.id for t in model(low)])
            elif _plain(low):
                shown = low.encode().decode("latin-1").translate(SHOWN)
                known[w] = ids_bytes([t.id for t in model(shown)])
            elif b"|" in w or b"<" in w:
                known[w] = ids_bytes(encode([text], add_special_tokens=False)[0].ids)
            else:
                rest.append(w)
        parts = [rest[at:at + 512] for at in range(0, len(rest), 512)]
        for at in range(0, len(parts), ENCODE_PARTS):
            own = parts[at:at + ENCODE_PARTS]
            texts = [b" | ".join(part).decode() for part in own]
            for part, found in zip(own, encode(texts, add_special_tokens=False)):
                ids = np.asarray(found.ids, dtype="<u4")
                ends = (4 * np.append(np.flatnonzero(ids == mark), ids.size)).tolist()
                raw, start = ids.tobytes(), 0
                for w, end in zip(part, ends):
                    known[w] = raw[start:end]
                    start = end + 4

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; new ones join the cache."""
        if len(self.known) > self.max_words // 2:
            self.old, self.known = self.known, {b"": b""}
        known, old = self.known, self.old
        found = list(map(known.get, words))
        holes = [i for i, ids in enumerate(found) if ids is None]
        new = {words[i] for i in holes}
        known.update((w, old[w]) for w in new.intersection(old))
        new = new.difference(old)
        # a byte that is a letter is an ASCII letter
        ended = {w: w[:-1] for w in new if w[-1:] in MARKS and (w[-2:-1].isalpha() or _plain(w[:-1].decode()[-1:].lower()))}
        plain = (new.difference(ended)).union(ended.values(), (w[-1:] for w in ended)).difference(known)
        known.update((w, old[w]) for w in plain.intersection(old))
        self._add(plain.difference(old))
        known.update((w, known[stem] + known[w[-1:]]) for w, stem in ended.items())
        for i in holes:
            found[i] = known[words[i]]
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end);
        null is empty.  Splitting and gathering are array operations; only a
        column's different words are looked up, for less than 2 GB at once."""
        if texts.type != pa.string():
            # not by a cast: string functions misread cast slices
            texts = pa.array(texts.to_pylist(), pa.string())
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        # Not where case matters: in special tokens' strings, and before a
        # combining mark, which may compose with one case of a letter only.
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u037f]"))
        if pc.any(odd).as_py():
            low = pc.if_else(odd, texts, low)
        split = pc.ascii_split_whitespace(low)
        offsets, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        ids = self._ids_of(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        begin = np.cumsum(size, dtype=np.int32) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        each = size[word]
        ends = np.cumsum(each, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(begin[word] - (ends - each), each)
        place += np.arange(total, dtype=np.int32)
        return flat[place], np.concatenate((np.zeros(1, dtype=np.int64), ends))[offsets[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1]) if len(ends) else []


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, max_words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder per Python worker, file and size of cache."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = WordEncoder(path, max_words)
    return _ENCODERS[path, max_words]
