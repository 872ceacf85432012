"""Spelling variants, language identification and fill-in-the-middle: brute force, round trips, edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, language, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "some words here"), (5, "x"), (5, "x"), (6, "ÀÉ́ ß÷ж 中文 😀"), (7, "long " * 40_000), (8, "z" * 300_000)]
CLASH = "doc_id long, text string, lang string, n string, form string, output string, score string, held_out string, lang_pred string, key string, word string, draw_0 string"


def clashing(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, *"abcdefghi") for i, t in rows], CLASH)


# --- fill in the middle


def cut_by_hand(doc_id, text, seed=1, rate=90, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return len(text), "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if d % 100 < suffix_first else "psm"
    return len(text), form, low, high - low, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_middle_is_brute_force_and_comes_back(spark):
    rng = random.Random(1)
    letters = "ab <>PSM/é÷ж中😀\n"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000, "a <P> b"), (1001, "<S>"), (1002, "<M"), (1003, "<<P<S<M>x"), *EDGES]
    made = fill_middle.fill_middle(clashing(spark, rows).drop("draw_1").repartition(3))
    assert set(made.columns) == {*CLASH.replace(" long", "").replace(" string", "").split(", ")} | set(fill_middle.ADDED)
    out = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    shown = lambda r: (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
    assert sorted(map(shown, out), key=str) == sorted(((i, *cut_by_hand(i, t)) for i, t in rows), key=str)
    assert all(r.back == (r.text or "") and r.draw_0 == "i" for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(clashing(spark, [])).count() == 0


def test_units_by_swar_words():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aé中😀\x00") for _ in range(rng.randint(0, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        units = fill_middle.Units(data)
        ends = np.cumsum([len(c.encode()) for c in text]).astype(np.int64)
        assert units.select(np.arange(1, len(text) + 1)).tolist() == ends.tolist()
        assert units.rank(np.concatenate([[0], ends]).astype(np.int64)).tolist() == list(range(len(text) + 1))


def test_other_marks_and_seeds(spark):
    marks = fill_middle.Marks("[pre]", "[suf]", "[mid]")
    rows = [(i, f"some [pr text [su number {i}") for i in range(50)]
    made = fill_middle.fill_middle(clashing(spark, rows), seed=9, rate=100, suffix_first=50, marks=marks)
    out = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text and "[mid]" in r.output for r in out) and {r.form for r in out} == {"psm", "spm"}
    for bad in ("", "aXa", "##"):
        with pytest.raises(ValueError, match="mark"):
            fill_middle.fill_middle(clashing(spark, rows), marks=fill_middle.Marks(prefix=bad))


# --- language identification


def grams_by_hand(text, sizes=language.SIZES):
    shown = re.sub(" +", " ", f" {''.join(c.lower()[0] if c.isalpha() else ' ' for c in text or '')} ")
    return [g for k in sizes for i in range(len(shown) - k + 1) if (g := shown[i : i + k]) != " " and "  " not in g]


def test_ngrams_are_those_of_plain_python():
    texts = ["Der, die — DAS", "", None, "x", "a1b  c", "é中😀 ŷ", "... !"]
    for bits in (10, 16):
        found = Counter()
        for number, bucket in language.ngrams(pa.array(texts), bits):
            found.update(number.tolist())
            assert bucket.max(initial=0) < 1 << bits
        assert found == Counter({i: len(g) for i, t in enumerate(texts) if (g := grams_by_hand(t))})
    # equal n-grams share a bucket, nearly all different ones do not
    place = {}
    for k, (number, bucket) in zip(language.SIZES, language.ngrams(pa.array(["the cat the dog the end"]), 30), strict=True):
        own = [g for g in grams_by_hand("the cat the dog the end") if len(g) == k]
        assert len(own) == len(bucket)
        for g, b in zip(own, bucket.tolist(), strict=True):
            assert place.setdefault(g, b) == b
    assert len(set(place.values())) == len(place)


def spoken(rng, lang, n):
    syllables = {"de": ["sch", "ung", "ein", "ver", "ich"], "fr": ["eau", "ille", "tion", "que", "ê"], "ж": ["жи", "ла", "на", "ко", "т"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_is_naive_bayes(spark):
    rng = random.Random(4)
    rows = [(i, spoken(rng, lang, rng.randint(1, 12)), lang) for i in range(300) for lang in [rng.choice(["de", "fr", "ж"])]]
    rows += [(1000 + i, t, l) for i, (t, l) in enumerate([(None, "de"), ("", "fr"), ("123 ...", "de"), ("schung", None), ("x", "ж")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identified(docs).collect()}
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    counts, priors = {}, Counter()
    for i, text, lang in rows:
        if not out[i].held_out and lang is not None:
            counts.setdefault(lang, Counter()).update(grams_by_hand(text))
            priors[lang] += 1
    width = 1 << language.bits_for(3)
    for i, text, _ in rows:
        own = grams_by_hand(text)
        if not own:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        logs = {
            lang: math.log(priors[lang] / priors.total())
            + sum(math.log((c[g] + language.SMOOTHING) / (c.total() + language.SMOOTHING * width)) for g in own)
            for lang, c in counts.items()
        }
        best = max(sorted(logs), key=logs.get)
        # hashed n-grams that share a bucket move the numbers a little
        assert out[i].lang_pred == best and out[i].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=0.02)
    held = [(out[i].lang_pred, lang) for i, text, lang in rows if out[i].held_out and text and lang]
    assert len(held) > 40 and all(a == b for a, b in held)


def test_language_edges(spark):
    out = language.identified(clashing(spark, EDGES)).collect()
    assert len(out) == len(EDGES) and {(r.doc_id, r.lang_pred) for r in out} == {(i, "en" if i not in (1, 2, 3) else "und") for i, _ in EDGES}
    assert all(r.score == pytest.approx(1.0 if r.lang_pred == "en" else 0.0) and r.key == "g" and r.form == "b" for r in out)
    assert language.identified(clashing(spark, [])).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identified(clashing(spark, EDGES, None)).collect()} == {("und", 0.0)}
    # the matrix keeps its bound whatever the number of languages
    assert all(n << language.bits_for(n) <= language.CELLS for n in (1, 4, 64, 65, 1000, 16_384))
    with pytest.raises(ValueError, match="languages"):
        language.bits_for(20_000)


# --- spelling variants


def damaged_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :]


def grouped_by_hand(n, ratio=10):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def typed(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abé÷") + word[k:], word[:k] + rng.choice("abé") + word[k + 1 :]])


def test_spelling_variants_are_brute_force(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12))) for _ in range(12)]
    words = []
    for stem in stems:
        words += [stem.upper() if rng.random() < 0.1 else stem for _ in range(rng.choice([5, 60, 600]))]
        for _ in range(10):
            once = typed(rng, stem)
            words += [once] * rng.choice([2, 3, 30]) + [typed(rng, once)] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))] + EDGES
    got = spelling.variants(clashing(spark, rows).repartition(4)).collect()
    n = damaged_by_hand(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == grouped_by_hand(n) and len(got) == len(n)
    assert any(r.root != r.form for r in got if r.form) and "z" * 300_000 not in n
    assert spelling.variants(clashing(spark, [])).count() == 0
    plain = spelling.vocabulary(clashing(spark, [(1, "Colour colour COLOURS colours")]), 6, damaged=None).collect()
    assert {(r.word, r.n) for r in plain} == {("colour", 2), ("colours", 2)}


@pytest.mark.parametrize("dense", [0, 2, 10**6])
def test_near_words_with_and_without_crowded_chunks(spark, dense):
    rng = random.Random(dense)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(250)}
    words |= {"aaaaaaa" + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(120)}
    found = [tuple(sorted(r)) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), dense).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and one_apart(a, b))


def test_crowded_chunks_do_not_make_all_pairs(spark):
    """2 000 words that share their first half: rows that meet stay near the number of true pairs."""
    rng = random.Random(3)
    words = {"aaaaaaaa" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(2000)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    chunks = spelling._shown(frame, 0, [(0, 0), (1, 0)])
    crowded = chunks.groupBy("key").count().where(F.col("count") > spelling.DENSE).select("key")
    sides = [spelling._keyed(chunks, crowded, -1, "a").drop("longer"), spelling._keyed(chunks, crowded, 0, "b")]
    assert crowded.count() == 1 and sides[0].join(sides[1], "key").where("a <> b").count() < 20_000


def test_runs_and_digests_of_bytes():
    texts = ["abc DÉf÷g", "", None, "ж1àb", "ab", "cd" * 100, "Ã"]
    data, start, end, number = spelling.runs_of(pa.array(texts))
    found = [(k, data[i:j].tobytes().decode()) for k, i, j in zip(number.tolist(), start.tolist(), end.tolist(), strict=True)]
    assert found == [(k, m.translate(LOWER)) for k, t in enumerate(texts) for m in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    heads = np.array([zlib.crc32(b"%d:" % k) for k in number], np.uint32)
    assert spelling.digests(data, start, end, heads).tolist() == [zlib.crc32(f"{k}:{w}".encode()) for k, w in found]
    with pytest.raises(ValueError, match="ratio"):
        spelling.grouped(None, 1)
