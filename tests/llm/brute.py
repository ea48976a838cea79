"""Plain Python versions of the operators, and awkward rows to hold them against."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SPACE = re.compile(r"[\x20\x09-\x0D]+")
_TOK = {}


def tok(name):
    if name not in _TOK:
        _TOK[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _TOK[name]


def awkward_docs(seed=0, n=120):
    """(doc_id, text) rows: nulls, blanks, ties, repeats, copies, control and wide characters, one very long text."""
    rnd = random.Random(seed)
    words = "the of and under mit license apache version 2 cc by nc strasse große naïve 漢字 🙂 x1 l'été don't A B".split()
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    rows = list(enumerate(prose))
    near = " ".join(rnd.choice(words) + str(i % 37) for i in range(400))
    rows += [(1000 + i, near.replace(f" {w} ", f" {w}x ", 1)) for i, w in enumerate(near.split()[5:30])]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "a"), (2004, "\x1c a\x1f\xa0b\x85"), (None, "the of and"), (None, None)]
    rows += [(3000 + i, prose[0]) for i in range(30)] + [(3100, prose[0] + " "), (3101, prose[0].replace(" ", "  "))]
    rows += [(3, prose[3]), (3, prose[3]), (3, "same id other text here with more words and more words")]
    rows += [(4000, "word " * 30_000), (4001, "z" * 20_000), (4002, "<|endoftext|> <|startoftext|>x<|endoftext|>"), (4003, "İstanbul ΑΣ ǅ é̀ ﬁ Å")]
    rows += [(4004, "UNDER the-MIT license, under the mit license under the mit\nlicense; Cc by\tnc apache license (version 2)")]
    return rows


def docs_frame(spark, rows):
    """With clashing and extra columns."""
    full = [(i, t, "en", "src", len(t or ""), "junk", 7) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, kept int")


def exact(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, at))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.append((i, rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out, sum(1 for _ in groups)


def fingerprint(text):
    words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)], len({find(i) for i in range(len(rows))})


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licences(rows):
    out = []
    for doc, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = {p: places(words, p) for p in BASE}
        every = sorted(x for v in found.values() for x in v)
        labels = ",".join(sorted({BASE[p] for p, v in found.items() if v}))
        out.append((doc, len(words), len(every), every[0] if every else None, every[-1] if every else None, labels))
    return out


def rules(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def pieces(rows, width=4096):
    out = []
    for doc, t in rows:
        ids = tok("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), width)):
            part = ids[at : at + width]
            out.append((doc, n, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out
