"""Token ids of ``word_bpe`` vocabularies by cached white-space chunks.

The vocabulary's rules never look across white space: a match of its
pre-tokenizer holds none, its normalizer composes and lower-cases within a
chunk, and its special strings contain none. So a text's ids are those of its
chunks, one after the other, and a chunk's ids can be kept.
"""

from __future__ import annotations

from array import array

import regex
from tokenizers import Tokenizer

#: Chunks in each of a worker cache's two generations.
CACHE_CHUNKS = 320_000
#: Longer chunks are encoded afresh each time.
CACHE_CHARS = 48

#: The published pattern of the vocabulary's pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN_ENDS = frozenset(".,;:!?")

_LOADED: dict[str, Tokenizer] = {}


def tokenizer_path(name: str, path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Tokenizer:
    """The library's tokenizer, once a worker, without truncation or padding."""
    if path not in _LOADED:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others, in order, for U+0100 onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunks(text: str) -> list[str]:
    """The parts of a text between ASCII white space.

    ``str.split`` also splits at some control and non-ASCII characters, which a
    chunk may hold: then the bytes are split, which only knows the ASCII ones.
    """
    if text.isascii():
        if not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
            return text.split()
    return [c.decode() for c in text.encode().split()]


class ChunkEncoder:
    """Encodes chunks, most of them without the library's normalizer and pre-tokenizer.

    In Latin-1 both are plain: composing changes nothing, a letter's lower case
    is one letter, and character classes are settled. Other chunks, and those
    that may hold a special string, go through the whole library.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        letters = {b: c for c, b in byte_alphabet().items()}
        self.table = {i: letters[i] for i in range(256)}

    def word_ids(self, word: str) -> list[int]:
        """The ids of letters in lower case, all of Latin-1. ASCII letters stand for themselves."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.table))]

    def ids(self, chunk: str) -> list[int]:
        if not chunk.isascii() and max(chunk) > "\xff" or "<|" in chunk:
            return self.tok.encode(chunk, add_special_tokens=False).ids
        chunk = chunk.lower()
        if chunk.isalpha():
            pieces = [chunk]
        elif chunk[-1] in _PLAIN_ENDS and chunk[:-1].isalpha():
            pieces = [chunk[:-1], chunk[-1]]
        else:
            pieces = PRE_TOKEN.findall(chunk)
        out: list[int] = []
        for piece in pieces:
            shown = piece.encode().decode("latin-1").translate(self.table)
            out.extend([t.id for t in self.model.tokenize(shown)])
        return out


class _Cache(dict):
    """Chunk -> value, in two generations: when the young one is full it becomes the old one, which is asked before computing afresh.

    A chunk that is a word, letters, but for capitals and a closing mark is that
    word's value and the mark's. Where the word is new only the word is kept:
    what occurs once doesn't push out what comes again.
    """

    def __init__(self, path: str, start: dict, most: int | None = None):
        super().__init__(start)
        self.encoder, self.start, self.old, self.most = ChunkEncoder(path), start, {}, (most or CACHE_CHUNKS) + len(start)
        self.marks = {m: self.value(m) for m in _PLAIN_ENDS}

    def pack(self, ids: list[int]):
        raise NotImplementedError

    def value(self, chunk: str):
        return self.pack(self.encoder.ids(chunk))

    def keep(self, chunk: str, got) -> None:
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self.update(self.start)
            self[chunk] = got

    def __missing__(self, chunk: str):
        got = self.old.get(chunk)
        if got is None:
            low = chunk.lower() if chunk.isascii() or max(chunk) <= "\xff" else ""
            mark = None
            if not low.isalpha():
                low, mark = (low[:-1], low[-1]) if low and low[-1] in _PLAIN_ENDS and low[:-1].isalpha() else ("", None)
            if not low:
                got = self.value(chunk)
            elif low == chunk:
                got = self.pack(self.encoder.word_ids(low))
            else:
                got = self.get(low)
                if got is None:
                    got = self.old.get(low)
                if got is None:
                    got = self.pack(self.encoder.word_ids(low))
                    self.keep(low, got)
                    return got if mark is None else got + self.marks[mark]
                if mark is not None:
                    got = got + self.marks[mark]
        self.keep(chunk, got)
        return got


class ChunkLengths(_Cache):
    """Chunk -> number of tokens, beginning with a shared table."""

    def pack(self, ids: list[int]) -> int:
        return len(ids)


class ChunkIds(_Cache):
    """Chunk -> its ids as packed unsigned 32-bit integers."""

    def pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()


_IDS: dict[tuple[str, int | None], ChunkIds] = {}


def id_cache(path: str, most: int | None = None) -> ChunkIds:
    if (path, most) not in _IDS:
        _IDS[path, most] = ChunkIds(path, {}, most)
    return _IDS[path, most]
