import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from frametide.llm import best_fit_packing, bpe_codec, chat_format, exact_dedup, license_scan, quality_rules, sharding, simhash_dedup, token_count, toxicity

ROWS = brute.awkward_docs()


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.docs_frame(spark, ROWS).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs)
    want, groups = brute.exact(ROWS)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=key)
    assert got.filter("kept").count() == groups
    stays = exact_dedup.drop_exact_copies(docs)
    assert stays.columns == docs.columns and stays.count() == groups


def test_merge_keeps_digest_collisions_apart():
    import pyarrow as pa

    batch = pa.table({"text_sha256": ["x", "x", "x"], "check64": [1, 2, 1], "norm_bytes": [5, 5, 5], "n_rows": [1, 1, 2], "keep_chars": [5, 5, 6], "keep_id": [9, 3, None], "keep_uid": [0, 1, 2]}).to_batches()
    merged = [r for b in exact_dedup._merge_sorted(iter(batch)) for r in b.to_pylist()]
    assert {(r["check64"], r["n_rows"], r["keep_id"]) for r in merged} == {(1, 3, None), (2, 1, 3)}


def test_token_counts(docs):
    want = []
    for i, t in ROWS:
        n = len(brute.tok("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    for options in ({}, {"table_rows": 5, "task_rows": 3}):
        assert rows_of(token_count.token_counts(docs, **options), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=key)


def test_frequent_words_come_from_every_split(spark):
    import public_tokenizers

    rows = [(i, f"word{i % 8} " * 50 + f"rare{i}") for i in range(64)]  # a split a topic
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, (F.col("doc_id") % 8)).select("doc_id", "text")
    assert set(token_count.frequent_lengths(docs, public_tokenizers.path("word_bpe_49k.json"), 8)) == {f"word{i}" for i in range(8)}


def test_bpe_round_trip(docs):
    tok = brute.tok("byte_bpe_50k.json")
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), tok.decode(ids, skip_special_tokens=False)))
    for done in (bpe_codec.decode_ids(bpe_codec.encode_texts(docs)), bpe_codec.round_trip(docs)):
        got = done.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) ids_sha256", "text")
        assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "text") == sorted(want, key=key)


def test_bpe_every_token_and_random_text():
    bpe = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json"))
    tok = brute.tok("byte_bpe_50k.json")
    rnd = random.Random(5)
    letters = [bpe.token(i).decode("utf-8", "ignore") for i in rnd.sample(range(50_256), 400)] + list("  \n\t'aeiou🙂é漢ա") + ["<|endoftext|>", "'ll", "1"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == e.ids
        assert bpe.decode(bpe.encode(text)) == tok.decode(e.ids, skip_special_tokens=False)


def test_bpe_work_is_linear():
    import time

    bpe = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json"))
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        bpe.encode_piece(b"ab" * n)
        times.append(time.process_time() - began)
    assert times[1] < 12 * max(times[0], 0.01)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a<b \\ c"), (2, 0, "user", "hi"), (2, 1, "assistant", "a<b \\ c"), (2, 2, "user", "more</turn>\n"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "system", None), (4, None, None, "x"), (5, 0, "us\ner<", ""), (5, 0, "us\ner<", ""),
    (None, 0, "assistant", "\\"), (6, 1, "assistant", "é🙂"), (6, 0, "user", "hi"), *[(100 + i, t, r, x) for i in range(200) for t, r, x in ((0, "system", "shared"), (1, "assistant", f"v{i % 7}"))],
]


def test_chat_format(spark):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, Role string, node int").repartition(7)
    forest = chat_format.prefix_forest(turns)
    convs = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: tuple((v is not None, v) for v in t)):
        convs.setdefault(c, []).append((r or "", x or ""))
    want = []
    for c, ts in convs.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        chars = sum(len(chat_format.render(r, x)) for r, x in ts)
        want.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    assert rows_of(chat_format.read_back(forest), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars") == sorted(want, key=key)

    nodes = {n["node"]: n for n in forest.nodes.collect()}
    prefixes = {tuple(ts[: i + 1]) for ts in convs.values() for i in range(len(ts))}
    assert len(nodes) == len(prefixes)  # shared turns once
    order = sorted(nodes.values(), key=lambda n: n["start"])
    at = 0
    stack = []
    for n in order:  # gapless, and depth first: a node follows its parent's open branch
        assert n["start"] == at
        at += n["chars"]
        del stack[n["depth"] :]
        assert (stack[-1] if stack else None) == n["parent"] and len(stack) == n["depth"]
        stack.append(n["node"])
        ancestors, up = set(), n["parent"]
        while up:
            ancestors |= set(range(nodes[up]["start"], nodes[up]["start"] + nodes[up]["chars"]))
            up = nodes[up]["parent"]
        assert {x for a in n["attention"] for x in range(a["start"], a["end"])} == ancestors
        assert n["position"] == len(ancestors)


def test_chat_is_read_through_intervals_and_positions(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    forest = chat_format.prefix_forest(turns)
    nodes = spark.createDataFrame(forest.nodes.collect(), forest.nodes.schema)
    want = rows_of(chat_format.read_back(chat_format.Forest(nodes, forest.conversations)), "conv_id", "turns_sha256")
    for page in (7, 1 << 30):  # many pages a node, and one for all
        assert rows_of(chat_format.read_back(chat_format.Forest(nodes, forest.conversations), page), "conv_id", "turns_sha256") == want
    broken = {
        "start": F.when(F.col("depth") == 1, F.col("start") + 1).otherwise(F.col("start")),
        "position": F.col("position") + F.col("depth"),
    }
    cut = nodes.withColumn("attention", F.when(F.size("attention") > 0, F.slice("attention", 2, 99)).otherwise(F.col("attention")))
    for bad in [cut, nodes.withColumn("attention", F.transform("attention", lambda a: F.struct((a["start"] + 1).alias("start"), a["end"].alias("end")))), *[nodes.withColumn(c, x) for c, x in broken.items()]]:
        with pytest.raises(Exception, match="position|expected"):
            chat_format.read_back(chat_format.Forest(bad, forest.conversations)).collect()


def test_chat_of_a_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (200_000 if i == 7 else 5)) for i in range(3000)]
    rows += [(2, i, r, t) for _, i, r, t in rows[:2000]] + [(None, 0, None, None)] * 3
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        ts = [(r, t) for k, _, r, t in rows if k == c]
        assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
    assert got[None]["n_turns"] == 3


def test_chat_escapes_read_back():
    rnd = random.Random(1)
    for _ in range(500):
        ts = [("".join(rnd.choice("ab\\<\nn>/") for _ in range(rnd.randint(0, 6))), "".join(rnd.choice("a\\<>\n/turn") for _ in range(rnd.randint(0, 20)))) for _ in range(3)]
        assert chat_format.parse("".join(chat_format.render(*t) for t in ts)) == ts


def toxic_corpus(n=600, seed=2):
    rnd = random.Random(seed)
    clean = [f"w{i}" for i in range(300)]
    bad = ["vile", "rotten", "hateful"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(2, 6) if toxic else rnd.random() < 0.02):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        if i < n // 2:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, docs, empty):
    rows, marks = toxic_corpus()
    frame = brute.docs_frame(spark, [*rows, (None, None), (9999, "")])
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    assert len(got) == len(rows) + 2
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 600]
    assert sum(r["is_toxic"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 and r["kept"] != r["is_toxic"] for r in got)
    assert not any(r["is_toxic"] for r in got if r["doc_id"] in (None, 9999))
    assert toxicity.drop_toxic(frame, labels).columns == frame.columns
    assert not any(r["is_toxic"] for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(empty, labels).count() == 0


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    grades = np.clip(np.floor(x @ [1.5, -1, 0] + 1.5 + rng.logistic(size=400) * 0.2), 0, 3).astype(int)
    rows, cols = np.nonzero(np.ones_like(x))
    w, thetas = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3)
    assert w[0] > 1 and w[1] < -0.7 and abs(w[2]) < 0.4 and (np.diff(thetas) > 0).all()
    assert np.abs(toxicity.expected_grade(x @ w, thetas) - grades).mean() < 0.5


def test_ordinal_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * (rng.random((60, 4)) < 0.6)
    rows, cols = np.nonzero(x)
    grades = rng.integers(0, 4, 60)
    for _ in range(5):
        params = rng.normal(size=4 + 3) * 0.7
        _, grad = toxicity.loss_and_gradient(params, rows, cols, x[rows, cols], grades, 4, 0.01)
        for i in range(len(params)):
            e = np.zeros(len(params))
            e[i] = 1e-6
            up, down = (toxicity.loss_and_gradient(params + s * e, rows, cols, x[rows, cols], grades, 4, 0.01)[0] for s in (1, -1))
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-5


def test_toxicity_sample_is_bounded_by_documents(spark):
    """A doc_id that repeats 10,000 times counts once, and labels without a document don't use up the bound."""
    rows, marks = toxic_corpus(300)
    rows += [(7, f"again {i}") for i in range(10_000)] + [(None, "nobody")] * 50
    marks = [*marks, *[(i, 1, i % 2) for i in range(5000, 9000)], (7, 1, 0), (7, 0, 1)]
    docs = brute.docs_frame(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, 100).collect()
    assert len(got) == 100 and len({r["doc_id"] for r in got}) == 100 and all(r["doc_id"] < 300 for r in got)
    whole = {r["doc_id"]: r for r in toxicity.labelled_sample(docs, labels, 10**6).collect()}
    assert len(whole) == 150 and whole[7]["toxic"] == 1
    assert toxicity.toxicity(docs, labels).count() == len(rows)


def test_toxicity_reads_whole_words_and_unspaced_scripts(spark):
    long = "a" * 70
    assert toxicity.features_of_chunk(long + "x")[0] != toxicity.features_of_chunk(long + "y")[0]
    assert "g:坏词" in toxicity.features_of_chunk("好" * 100 + "坏词" + "好" * 100)
    rnd = random.Random(6)
    clean = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    rows = []
    for i in range(1200):
        text = "".join(rnd.choice(clean) for _ in range(rnd.randint(40, 90)))
        at = rnd.randrange(20, len(text))
        rows.append((i, text[:at] + "恶毒" + text[at:] if i % 5 == 0 else text))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(brute.docs_frame(spark, rows), labels).collect()
    assert sum(r["is_toxic"] == (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] >= 800) >= 0.95 * 400


def test_toxicity_awkward_rows_under_a_model(spark, docs):
    rows, marks = toxic_corpus()
    frame = brute.docs_frame(spark, rows + [(i, t) for i, t in ROWS if i is None or i >= 1000])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    assert len(got) == frame.count()
    assert not any(r["is_toxic"] for r in got if r["doc_id"] is None or r["doc_id"] >= 1000)


def test_simhash(docs):
    got = simhash_dedup.simhash_groups(docs)
    want, groups = brute.near(ROWS)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=key)
    assert got.filter("kept").count() == groups
    left = simhash_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == groups


def test_trie_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    flips = lambda v, k: np.bitwise_xor.reduce([v] + [np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64) for _ in range(k)])
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    v = np.unique(np.concatenate([base, *[flips(base, k) for k in range(1, 6)], flips(np.full(800, base[0]), 3)]))
    frame = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    for block, most in ((10**6, 10**6), (50, 10**6), (10**6, 40), (50, 20)):  # one unit a trie, many, and large ones split
        edges = simhash_dedup.links(frame, len(v), block, most)
        found = {r["u"]: r["v"] for r in simhash_dedup.components(edges).collect()}
        label = np.arange(len(v))
        x, y = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)
        forest = simhash_dedup.Forest(len(v))
        forest.link(x, y)
        groups = {}
        for i, r in enumerate(forest.label):
            groups.setdefault(int(r), []).append(int(v.view(np.int64)[i]))
        want = {m: min(g) for g in groups.values() for m in g if m != min(g)}
        assert found == want and len(label) == len(v)


def test_large_units_are_split(spark):
    """A dense family: no unit keeps more than the bound while the leading part goes on."""
    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 52, 3000, dtype=np.uint64)  # all share their first 12 bits
    frame = spark.createDataFrame([(int(x),) for x in np.unique(low).view(np.int64)], "fp long")
    rows = simhash_dedup._split(simhash_dedup._units(frame, 0), 0, 200)
    sizes = rows.groupBy(*simhash_dedup._UNIT).count().collect()
    assert max(r["count"] for r in sizes) <= 200 and len({r["depth"] for r in sizes}) > 3


def test_licences(docs):
    got = license_scan.license_scan(docs)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.licences(ROWS), key=key)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and (r["score"] > 0) == bool(r["labels"])


def brute_licences(rows, templates):
    """Labels and best score of each text, one place at a time."""
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    df = Counter(w for words in texts for w in set(words))
    out = []
    for words in texts:
        labels, score = set(), 0.0
        for t in templates:
            tw, tk = license_scan.split_words(t.text), license_scan.split_words(t.key)
            at = brute.places(tw, t.key)[0] if not t.base else 0
            first = {w: i for i, w in reversed(list(enumerate(tw)))}
            rare = sorted(first, key=lambda w: (df[w], w))[: 1 if t.base else license_scan.PLACES]
            for p in range(len(words) - len(tk) + 1):
                if words[p : p + len(tk)] == tk:
                    there = lambda i: 0 <= p - at + i < len(words) and words[p - at + i] == tw[i]  # noqa: B023, E731
                    if 2 * sum(there(first[w]) for w in rare) >= len(rare):
                        labels.add(t.label)
                        score = max(score, 1.0 if t.base else sum(map(there, range(len(tw)))) / len(tw))
        out.append((",".join(sorted(labels)), score))
    return out


def licence_rows(seed=9):
    """Whole licences, their beginnings, middles and ends, with words changed, dropped and put in, and key phrases alone."""
    rnd = random.Random(seed)
    rows = []
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        rows += ["some words before. " + t.text.upper() + "\nand after", t.key, "x " + t.key + " y"]
        for share in (0.3, 0.5, 0.7, 0.9):
            n = int(share * len(words))
            rows += [" ".join(words[:n]), " ".join(words[len(words) - n :]), " ".join(w if rnd.random() < share else "changed" for w in words)]
        at = rnd.randrange(len(words))
        rows += [" ".join([*words[:at], "inserted", *words[at:]]), " ".join(words[:at] + words[at + 1 :]), t.text + " " + t.text]
    return [*enumerate(rows, 100_000), (9000, "license " * 5000), (9001, "gnu general public licence"), (9002, "this wor\u212a is licensed under a creative commons attribution 4 0 international license")]


def test_licence_templates(spark):
    rows = licence_rows() + ROWS
    got = license_scan.license_scan(brute.docs_frame(spark, rows)).collect()
    want = brute_licences(rows, license_scan.TEMPLATES)
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == Counter((i, x, round(s, 9)) for (i, _), (x, s) in zip(rows, want))
    found = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    at = 100_000
    for t in license_scan.TEMPLATES:
        whole, alone = found[at], found[at + 1]
        assert t.label in whole["labels"].split(",") and whole["score"] == 1.0
        assert (t.label, 3) in {(m["label"], m["word"]) for m in whole["matches"]}
        if not t.base and len(license_scan.split_words(t.text)) > 40:  # the key stands, but its licence doesn't: positions decide
            assert t.label not in alone["labels"].split(",")
        at += 18
    assert found[9000]["labels"] == found[9001]["labels"] == ""
    assert found[9002]["labels"] == "cc-by" and abs(found[9002]["score"] - 12 / 13) < 1e-9  # the Kelvin sign isn't a k


def test_licence_index_of_many_templates(spark):
    from frametide.llm.licences import Template

    words = lambda i: " ".join(f"term{i}x{j}" for j in range(30))
    many = tuple(Template(f"l{i:03}", words(i), f"term{i}x4 term{i}x5") for i in range(300))
    rows = [(i, f"before {words(i)} after") for i in range(0, 300, 7)] + [(999, None)]
    got = license_scan.license_scan(brute.docs_frame(spark, rows), many).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {i: f"l{i:03}" if i < 300 else "" for i, _ in rows}


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs)
    want = [(i, *brute.rules(t)) for i, t in ROWS]
    assert rows_of(got, "doc_id", *quality_rules.MEASURES[:5]) == sorted(want, key=key)
    book = got.collect()
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in book)
    assert quality_rules.drop_low_quality(docs).count() == sum(r["kept"] for r in book)
    whole = quality_rules.mask(quality_rules.POLICIES["v2"])
    for r in quality_rules.ablations(got).collect():
        bit = 1 << list(quality_rules.RULES).index(r["rule"])
        assert r["n_failed"] == sum(b["failed"] & bit > 0 for b in book)
        assert r["n_only"] == sum(b["failed"] & whole == bit for b in book)
        assert r["n_kept_without"] == sum(not b["failed"] & whole & ~bit for b in book)


def test_repeated_words_of_long_texts():
    rnd = random.Random(3)
    for n in (5, 6, 30, 400):
        for _ in range(60):
            words = [rnd.choice([b"a", b"b", b"c", b"d"][: rnd.randint(1, 4)]) for _ in range(n)]
            text = b" ".join(words).decode()
            for width in (2, 3, 5, 6, 8):
                windows = [tuple(words[i : i + width]) for i in range(n - width + 1)]
                times = Counter(windows)
                want = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(width)})
                assert quality_rules._repeated_in_long(words, width) == want if n - width + 1 >= 2 else True
                assert quality_rules.repeated_words(words, width) == want
            assert quality_rules.measure(text)[4] == brute.rules(text)[4]


def test_merge_finds_runs(spark):
    import pyarrow as pa

    rnd = random.Random(2)
    runs = [sorted((f"{rnd.randrange(300):064x}", 1, 5) for _ in range(200)) for _ in range(4)]
    rows = [(s, c, n, 1, 10, i, i) for i, (s, c, n) in enumerate(r for run in runs for r in run)]
    names = [c.split()[0] for c in exact_dedup.RUN.split(", ")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 57]]) for i in range(0, len(rows), 57)]
    merged = [r for b in exact_dedup._merge_runs(iter(batches)) for r in b.to_pylist()]
    assert [r["text_sha256"] for r in merged] == sorted({r[0] for r in rows}) and sum(r["n_rows"] for r in merged) == len(rows)
    least = {}
    for r in rows:
        least[r[0]] = min(least.get(r[0], r[5]), r[5])
    assert {r["text_sha256"]: r["keep_id"] for r in merged} == least


def check_packing(rows, width=4096):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= width
    return len(by)


def test_packing(docs):
    got = best_fit_packing.best_fit_packing(docs)
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces(ROWS), key=key)
    rows = got.collect()
    n = check_packing(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_plan_is_best_fit():
    rnd = random.Random(4)
    for width in (10, 64, 500):
        lengths = [rnd.randint(1, width) for _ in range(rnd.randint(0, 900))]
        slots = best_fit_packing.plan_slots(Counter(lengths), width)
        rooms = []
        for n in sorted(lengths, reverse=True):  # one document at a time
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(width - n)
        rows = [{"sequence_id": s[3] + i, "offset": s[4], "length": s[0]} for s in slots for i in range(s[2])]
        assert Counter(r["length"] for r in rows) == Counter(lengths)
        assert check_packing(rows, width) == len(rooms)


def test_sharding(docs):
    records = sharding.with_size(docs).select("doc_id", "size", "text_crc32")
    for bucket in (1 << 25, 200):
        got = sharding.external_shuffle(records, key="doc_id", size="size", bucket_bytes=bucket).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots = {}
        for r in got:
            assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})


def test_sharding_writes_whole_texts(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(ROWS)
    for folder in (tmp_path / "out").glob("shard=*"):  # files by name hold a shard's slots in order
        slots = [r for f in sorted(folder.glob("*.parquet")) for r in pq.read_table(f, partitioning=None).column("slot").to_pylist()]
        assert slots == list(range(len(slots)))


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0
    assert token_count.token_counts(empty).count() == 0
    assert bpe_codec.decode_ids(bpe_codec.encode_texts(empty)).count() == 0 and bpe_codec.round_trip(empty).count() == 0
    assert simhash_dedup.simhash_groups(empty).count() == 0 and simhash_dedup.drop_near_copies(empty).count() == 0
    assert license_scan.license_scan(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert best_fit_packing.best_fit_packing(empty).count() == 0
    assert sharding.external_shuffle(sharding.with_size(empty), key="doc_id", size="size").count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.prefix_forest(turns)).count() == 0
