"""License scans by a positional index of rare licence words.

The templates' words are few, so their document frequencies over the whole corpus
are counted first, one small row each. They say which words of a template are
rare: the index has, of each template, its ``PLACES`` words of highest IDF, that
is word -> postings (template, place in the template). It is a constant of the
plan, whose size doesn't follow the number of templates.

A file's words that the index has are its highest-IDF licence words: the common
ones of any licence are left out. Each such word with each of its postings says
where that template would begin in the file. Sorting these intersects the
postings by relative position: a template begins where at least ``AGREE`` of its
indexed words, from anywhere in its text, agree on one beginning. What is left is
verified: the template's mandatory key phrase must stand at its place word for
word. A quoted key phrase without its licence around it therefore isn't one.

All of it is one projection of JVM expressions over a file's array of words; the
only shuffle is that of the licence words' frequencies. Memory grows with a
file's words: a word has at most one posting a template.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm._common import pick, table
from frametide.llm.licences import TEMPLATES, Template

#: What separates words: ASCII characters that are neither digits nor letters, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places of a template that the index has, and the share of them that must agree. A base phrase has one place: none of it can be missed.
PLACES = 16
AGREE = 0.5

#: A beginning is packed into a long: the template, and the first word's place, which may lie before the text.
_BITS, _BEFORE = 33, 4096
_INDEX = "array<struct<label: string, base: boolean, need: int, key_at: int, key: array<string>, words: array<string>>>"


def words_of(text: Column) -> Column:
    """A text's words, A-Z in lower case.

    ``lower`` changes other letters too, which can make no difference here: only
    the Kelvin sign would become an ASCII letter, so it is set aside, and words
    with a letter beyond ASCII are in no template.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def split_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def key_at(template: Template) -> int:
    words, key = split_words(template.text), split_words(template.key)
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def document_frequencies(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Documents that hold each of the templates' words, over all of a table with an array ``words``."""
    vocabulary = sorted({w for t in templates for w in split_words(t.text)})
    found = files.select(F.explode(F.array_intersect("words", F.split(F.lit(" ".join(vocabulary)), " "))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a template word
    return {w: counts.get(w, 0) for w in vocabulary}


def indexed(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The words by which a template is looked up, the rarest first (the first in the alphabet of ties), each with its first place."""
    words = split_words(template.text)
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    ranked = sorted(first.items(), key=lambda x: (df.get(x[0], 0), x[0]))
    return ranked[: 1 if template.base else PLACES]


def _constant(value: object, kind: str) -> Column:
    """A value of any type as one literal of the plan, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licences named or quoted in every whole text.

    Columns: doc_id, n_words, n_base (all places of base phrases), first_word
    and last_word (the smallest and largest word at which one begins, from 0;
    null if there is none), base_labels and labels (distinct, sorted, comma-
    joined; empty if none), score (the best share of a template's words found in
    place, 1 for a base phrase, 0 without a match), matches (array of label,
    first word, which is negative if the text begins inside the licence, and
    share). A null text counts as empty; rows with a null or repeated doc_id are
    scanned each for itself; an empty table gives an empty one; columns other
    than doc_id and text are ignored.
    """
    files = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    df = document_frequencies(files, templates)
    postings: dict[str, list[int]] = {}
    index = []
    for n, t in enumerate(templates):
        places = indexed(t, df)
        for word, at in places:
            postings.setdefault(word, []).append((n << _BITS) + _BEFORE - at)
        need = math.ceil(AGREE * len(places))
        index.append({"label": t.label, "base": t.base, "need": need, "key_at": key_at(t), "key": split_words(t.key), "words": split_words(t.text)})
    index_, postings_ = _constant(index, _INDEX), _constant(postings, "map<string, array<bigint>>")
    template = lambda c: F.get(index_, F.shiftright(c, _BITS).cast("int"))
    start = lambda c: (c.bitwiseAND(F.lit((1 << _BITS) - 1)) - _BEFORE).cast("int")

    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i")))))
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(postings_, h["w"]), lambda p: p + h["i"])))
    # Sorted, a beginning that has as many votes as it needs has itself so many places further on.
    agreed = F.array_distinct(F.array_compact(F.transform("votes", lambda c, i: F.when(F.get("votes", i + template(c)["need"] - 1) == c, c))))
    first = lambda c: start(c) + template(c)["key_at"]
    key = lambda c: F.when(first(c) >= 0, F.slice("words", F.greatest(first(c), F.lit(0)) + 1, F.size(template(c)["key"])))
    verified = F.filter("agreed", lambda c: F.coalesce(key(c) == template(c)["key"], F.lit(False)))

    def match(c: Column) -> Column:
        words = template(c)["words"]
        in_place = F.size(F.filter(words, lambda w, i: F.coalesce(F.get("words", start(c) + i) == w, F.lit(False))))
        share = F.when(template(c)["base"], F.lit(1.0)).otherwise(in_place / F.size(words).cast("double"))
        return F.struct(template(c)["label"].alias("label"), start(c).cast("long").alias("word"), share.alias("share"), template(c)["base"].alias("base"))

    found = files.withColumn("hits", hits).withColumn("n_words", F.size("words").cast("long"))
    # A file without hits has no votes: nothing more is evaluated for it.
    found = found.withColumn("votes", F.when(F.size("hits") > 0, F.sort_array(votes)))
    found = found.withColumn("agreed", F.when(F.size("votes") > 0, agreed))
    found = found.withColumn("matches", F.when(F.size("agreed") > 0, F.transform(verified, match)))
    found = found.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label: string, word: bigint, share: double, base: boolean>>")))
    base = F.filter("matches", lambda m: m["base"])
    named = lambda which: F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda m: m["label"]))), ",")
    place = F.transform(base, lambda m: m["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.transform("matches", lambda m: F.struct(m["label"].alias("label"), m["word"].alias("word"), m["share"].alias("share"))).alias("matches"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The scan as DuckDB SQL: beginnings come from the key phrases, and their indexed words are counted."""
    quoted = lambda text: "string_split('" + " ".join(split_words(text)) + "', ' ')"
    rows = ",\n    ".join(f"({n}, '{t.label}', {quoted(t.text)}, {quoted(t.key)}, {key_at(t)}, {str(t.base).lower()})" for n, t in enumerate(templates))
    return rf"""
WITH t(id, label, tw, tk, key_at, base) AS (VALUES
    {rows}
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words,
         row_number() OVER () AS uid
  FROM documents
), tp AS (
  SELECT id, base, w, min(q) AS q FROM (SELECT id, base, unnest(tw) AS w, unnest(range(len(tw))) AS q FROM t) GROUP BY id, base, w
), df AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS w FROM d) WHERE w IN (SELECT w FROM tp) GROUP BY w
), ranked AS (
  SELECT id, base, w, q, row_number() OVER (PARTITION BY id ORDER BY coalesce(n, 0), w) AS r FROM tp LEFT JOIN df USING (w)
), idx AS (
  SELECT id, list(w ORDER BY r) AS iw, list(q ORDER BY r) AS iq FROM ranked WHERE r <= CASE WHEN base THEN 1 ELSE {PLACES} END GROUP BY id
), f AS (
  SELECT uid, words, t.*, iw, iq, unnest(list_filter(range(1, greatest(len(words) - len(tk) + 2, 1)), lambda i: words[i:i + len(tk) - 1] = tk)) - key_at AS start
  FROM d, t JOIN idx USING (id) WHERE list_has_all(words, tk)
), m AS (
  SELECT uid, label, base, start,
         len(list_filter(range(1, len(iw) + 1), lambda j: start + iq[j] >= 1 AND words[start + iq[j]] = iw[j])) AS votes, ceil({AGREE} * len(iw)) AS need,
         CASE WHEN base THEN 1.0 ELSE len(list_filter(range(0, len(tw)), lambda j: start + j >= 1 AND words[start + j] = tw[j + 1])) / len(tw)::DOUBLE END AS share
  FROM f
), g AS (
  SELECT uid, count(*) FILTER (WHERE base) AS n_base, min(start - 1) FILTER (WHERE base) AS first_word, max(start - 1) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM m WHERE votes >= need GROUP BY uid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (uid)
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
