"""Byte-level BPE, encoded by backtracking in linear time and decoded by an offset table.

A merge-based encoder repeats "merge the pair of lowest rank". Its result can be
found left to right instead: it is the only sequence of tokens in which every
two neighbours are *compatible*, that is, the merges of their joint bytes stop
at exactly these two. So the encoder takes the longest token that matches at a
position, checks it against the token before in a pair-compatibility table, and
on a conflict falls back to the next shorter token that is a prefix, or steps
back one token. A bit for each position marks dead ends, so none is entered
twice and the work stays linear. All matches come from one pass of an
Aho-Corasick automaton over the bytes.

Decoding gathers the bytes of all ids from one blob through a table of offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import pick, table
from frametide.llm._words import byte_alphabet, load, tokenizer_path

#: The published pattern of byte-level BPE pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters outside these ranges may have changed class between the Unicode
#: versions of the two regex libraries; texts with them are cut by the tokenizers library.
UNSETTLED = regex.compile("[^\x00-\u0557\u1e00-\u206f\u20a0-\u20bf\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")

CACHE_TOKENS = 200_000
CACHE_CHARS = 48
CACHE_PAIRS = 500_000


class ByteBpe:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library.

    What only the encoder needs is built when it is first used: a worker that
    decodes holds the tokens' bytes and offsets, nothing else.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = max([*vocab.values(), *self.specials.values()]) + 1
        token_bytes: list[bytes] = [b""] * self.n_ids
        for token, i in vocab.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            token_bytes[i] = token.encode()
        #: The decoder's blob, and where each id's bytes start in it.
        self.blob = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in token_bytes])]).astype(np.int64)
        self.ready = False

    def token(self, i: int) -> bytes:
        return self.blob[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def prepare(self) -> None:
        """Builds the encoder's tables."""
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pre_tokenizer = load(self.path).pre_tokenizer
        #: Of each merge: its rank, and of each token: the merge that makes it.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at = [-1] * self.n_ids
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = pair, rank
        self.by_bytes = by_bytes = {self.token(i): i for i in vocab.values()}
        self.size = np.diff(self.offsets).tolist()
        #: Of each token: the longest token that is a proper prefix of it; -1: none.
        self.shorter = [-1] * self.n_ids
        for raw, i in by_bytes.items():
            for n in range(len(raw) - 1, 0, -1):
                if raw[:n] in by_bytes:
                    self.shorter[i] = by_bytes[raw[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for raw, i in by_bytes.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        #: Pre-token -> packed ids, in two generations.
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ready = True

    def pair_ok(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens together ends in just these two.

        Looks at the seam only: the tokens that touch it, undone one merge at a
        time from the latest on. A merge across the seam must come no earlier
        than the merges that took its two sides away from the seam.
        """
        got = self.compatible.get((left, right))
        if got is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            got = self.compatible[left, right] = self._seam(left, right)
        return got

    def _seam(self, left: int, right: int) -> bool:
        # The seam's neighbours before any merge are single bytes. Each side then
        # grows by the merges along its edge; ``deadline`` is when the one that
        # stands there now is next taken up into a larger token.
        never = len(self.rank) + 1
        a, b = self._edge(left, last=True), self._edge(right, last=False)
        i = j = 0
        while True:
            gone_a, gone_b = a[i][1], b[j][1]
            across = self.rank.get((a[i][0], b[j][0]), never)
            # At equal rank the pair further left is merged first.
            if across < gone_a and across <= gone_b and across != never:
                return False
            if gone_a == never and gone_b == never:
                return True
            if gone_a <= gone_b:
                i += 1
                if gone_a == gone_b and i < len(a) and self.rank.get((a[i][0], b[j][0]), never) > gone_b:
                    j += 1
            else:
                j += 1

    def _edge(self, token: int, last: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is built, first to last, each with the rank that ends it."""
        never = len(self.rank) + 1
        chain = [(token, never)]
        while token in self.parts:
            rank = self.made_at[token]
            token = self.parts[token][last]
            chain.append((token, rank))
        return chain[::-1]

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        if not self.ready:
            self.prepare()
        whole = self.by_bytes.get(raw)
        if whole is not None:  # every token of the vocabulary encodes to itself
            return [whole]
        n = len(raw)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            start = end - size[token] + 1
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + size[token]
            if alive[end]:
                ok = True if last < 0 else compatible.get((last, token))
                if ok is None:
                    ok = self.pair_ok(last, token)
                if ok:
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                last = out[-1] if out else -1
        return out

    def pack(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_TOKENS:
                    self.old, self.cache = self.cache, {}
                self.cache[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return PRE_TOKEN.findall(text)

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if not self.ready:
            self.prepare()
        if self.split_special is None or "<|" not in text:
            return b"".join(map(self.pack, self.pieces(text)))
        out = []
        for part in self.split_special.split(text):
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
            elif part:
                out.extend(map(self.pack, self.pieces(part)))
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[source].tobytes()

    def decode(self, ids: bytes, block: int = 1 << 18) -> str:
        """The text of packed ids; special tokens stay, bytes that aren't UTF-8 become U+FFFD."""
        all_ids = np.frombuffer(ids, "<u4").astype(np.int64)
        return b"".join(self.decode_bytes(all_ids[i : i + block]) for i in range(0, len(all_ids), block)).decode("utf-8", "replace")


_CODECS: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def _by_size(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` bytes in the column of place ``size``."""
    held, out = 0, []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[] for _ in kinds], kinds)], names=names)
    for row in rows:
        out.append(row)
        held += len(row[size])
        if held > limit:
            yield batch_of()
            held = 0
            out.clear()
    yield batch_of()


def encode_texts(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Encodes every whole text: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a byte-level BPE file, byte_bpe_50k.json by
    default. Ids are the tokenizers library's without added special tokens;
    special strings inside texts become their ids. A null text counts as empty;
    rows with a null or repeated doc_id are encoded each for itself; an empty
    table gives an empty one; other columns are ignored.
    """
    path = tokenizer_path("byte_bpe_50k.json", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = ((d, bpe.encode(t.as_py() or "")) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")))
            yield from _by_size(((d, len(i) // 4, i) for d, i in ids), ["doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.binary()], 2)

    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Decodes packed ids: doc_id, n_tokens, ids, text. A null list of ids counts as empty; rows are decoded each for itself; other columns are ignored."""
    path = tokenizer_path("byte_bpe_50k.json", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = ((d, i.as_py() or b"") for d, i in zip(batch.column("doc_id").to_pylist(), batch.column("ids")))
            yield from _by_size(((d, len(i) // 4, i, bpe.decode(i)) for d, i in ids), *_DECODED)

    return pick(encoded, "doc_id", "ids").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


_DECODED = (["doc_id", "n_tokens", "ids", "text"], [pa.int64(), pa.int64(), pa.binary(), pa.string()], 2)


def round_trip(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """:func:`encode_texts`, then :func:`decode_ids`, by one worker in one pass: doc_id, n_tokens, ids, text (as decoded). Edge cases are those of the two."""
    path = tokenizer_path("byte_bpe_50k.json", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = ((d, bpe.encode(t.as_py() or "")) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")))
            yield from _by_size(((d, len(i) // 4, i, bpe.decode(i)) for d, i in ids), *_DECODED)

    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
