"""Hyperdimensional language profiles."""

import math
import zlib

import numpy as np
import pytest

from quarry.llm import language_profiles as lp
from quarry.llm.registry import op11_language_id
from quarry.llm.tables import table

DOCS = "doc_id long, text string, lang string"


def by_hand(text, size=lp.SIZE):
    """The bundle of a text, n-gram by n-gram."""
    kept = []
    for c in text.casefold():
        kept.append(ord(c) if c.isalpha() else 0)
    seq = [0]
    for p in kept:
        if p or seq[-1]:
            seq.append(p)
    if seq[-1]:
        seq.append(0)
    out = np.zeros(size, np.int64)
    for i in range(len(seq) - 2):
        v = lp.letter_vectors(np.array(seq[i : i + 3]), size, lp.SEED).astype(np.int64)
        out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def bundle(text, part=None, monkeypatch=None):
    if part:
        monkeypatch.setattr(lp, "PART", part)
    total, letter = np.zeros((1, lp.SIZE), np.int64), np.zeros(1, bool)
    lp.add_bundles(total, letter, [text], [0])
    return total[0], letter[0]


@pytest.mark.parametrize("part", [None, 1, 2, 3, 7])
def test_bundle_equals_gram_by_gram(part, monkeypatch):
    text = "Straße, ÉTÉ 42!! a  b\n\n日本語 x"
    got, letter = bundle(text, part, monkeypatch)
    assert letter and (got == by_hand(text)).all()


def test_vectors_are_random_and_fixed():
    v = lp.letter_vectors(np.arange(97, 123), 1024, 1).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    off = (v @ v.T)[~np.eye(26, dtype=bool)]
    assert abs(off).max() < 6 * math.sqrt(1024)
    assert (v[3] == lp.letter_vectors(np.array([100]), 1024, 1)[0]).all()


def test_cosines_equal_brute_force(spark):
    texts = [("en", "the cat and the dog"), ("en", "that is the thing"), ("fr", "le chat et le chien"), ("fr", "c'est la vie, quelle chose"), (None, "nothing to learn")]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in lp.identify_languages(docs, lp.learn_profiles(docs)).collect()}
    known = {}
    for k, t, lang in rows:
        if lang and zlib.crc32(str(k).encode()) % 3 != 1:
            known[lang] = known.get(lang, 0) + by_hand(t)
    for k, t, _ in rows:
        v = by_hand(t)
        cos = {lang: round(max(0.0, float(v @ p / math.sqrt((v @ v) * float(p @ p)))), 6) for lang, p in known.items()}
        best = min(cos, key=lambda x: (-cos[x], x))
        assert got[k]["lang_pred"] == best and abs(got[k]["score"] - cos[best]) < 1e-5
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_held_out_accuracy_and_nothing_but_the_text(spark, small):
    got = op11_language_id(spark, small).toPandas()
    docs = table(spark, small, "documents").select("doc_id", "lang", "n_chars").toPandas()
    rows = got.merge(docs, on="doc_id")
    rows = rows[rows.held_out & (rows.n_chars > 40)]
    assert len(got) == len(docs) and len(rows) > 200 and (rows.lang == rows.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_nulls_repeats_clashes_and_partitions(spark):
    rows = [(1, "the cat and the dog", "en"), (8, "le chat et le chien", "fr"), (None, "the dog", "xx"), (3, None, "en"), (4, "", "en"), (5, " 12 .. ", "fr"), (6, "THE DOG", None), (6, "the dog", None), (7, "le chien " * 70_000, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", score int, held_out int, `a.b` int")
    profiles = lp.learn_profiles(docs)
    assert profiles.languages == ("en", "fr")  # a null id is never learned from
    out = lp.identify_languages(docs, profiles).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by[3] == by[4] == by[5] == ("und", 0.0) and by[7][0] == "fr" and by[None][0] == by[6][0] == "en"
    assert sorted(map(str, out)) == sorted(map(str, lp.identify_languages(docs.repartition(5), lp.learn_profiles(docs.repartition(3))).collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    profiles = lp.learn_profiles(none)
    assert profiles.languages == () and lp.identify_languages(none, profiles).count() == 0
    out = lp.identify_languages(spark.createDataFrame([(1, "words", "en")], DOCS), profiles).first()
    assert (out["lang_pred"], out["score"]) == ("und", 0.0)
    with pytest.raises(ValueError):
        lp.learn_profiles(none, size=100)
