"""Each operator against brute force, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import sys
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute
import public_tokenizers

from bitweave.llm import common, exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, substring_dedup, url_filter, va_file, warc
from bitweave.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, chunk int, bucket int, address string, tokens string, layer int"
EMPTY_NAMES = (None,) * 7


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, *EMPTY_NAMES) for i, t, lang, s in rows], DOCS)


def corpus(seed=1):
    """Prose with copies, near copies, shared passages, odd white space, nulls, empties, repeats and a long text."""
    rng = random.Random(seed)
    vocabulary = {"en": ["the", "ship", "sailed", "north", "with", "wind", "Away"], "de": ["und", "der", "schöne", "für", "Straße", "über"], "fr": ["été", "où", "la", "garçon", "naïve", "être"]}
    passage = " ".join(rng.choice(vocabulary["en"]) + str(i) for i in range(50))
    rows = []
    for i in range(60):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randrange(1, 160))]
        if i % 7 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), lang if i % 9 else None, f"src{i % 3}"))
    rows += [(100 + i, rows[i][1].replace(" ", "  "), rows[i][2], "src0") for i in range(8)]
    for k in range(8):
        words = rows[20 + k][1].split()
        if len(words) > 30:
            words[5] = "changed"
        rows.append((200 + k, " ".join(words), rows[20 + k][2], None))
    rows += [(300, None, None, None), (301, "", "en", "src1"), (302, " \n\t ", "fr", "src1"), (303, "...!? 123", "de", "src2"), (304, "one", "en", "src2"), (305, "one two", "en", "src2")]
    rows += [(400, rows[3][1], rows[3][2], "src1"), (400, rows[3][1], rows[3][2], "src1"), (None, rows[4][1], rows[4][2], "src1"), (401, " ".join(f"w{i % 700}" for i in range(20_000)), "en", "src0")]
    rows.append((402, "x\u00a0y \x1cz \u2003 é", "en", "src0"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def key(x):
    return tuple((v is None, v) if not isinstance(v, bool) else (False, v) for v in x)


# --- 1


@pytest.mark.parametrize(("window", "base"), [(35, 18), (35, 5), (8, 2), (3, 18)])
def test_substring_dedup(docs, rows, window, base):
    out = substring_dedup.remove_repeats(docs, window, base, chunk_bytes=4000, bucket_entries=500)
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256), "removed").collect()
    want = brute.substring_dedup([r[1] for r in rows], window)
    assert sorted((key(r[:4]) for r in got)) == sorted(key((rows[i][0], *w)) for i, w in enumerate(want))
    assert all(sum(s.length for s in r.removed) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)


def test_substring_levels():
    assert substring_dedup.levels(35, 18) == [18, 35] and substring_dedup.levels(35, 5) == [5, 9, 18, 35] and substring_dedup.levels(4, 9) == [4]


def test_doubling_ends_without_candidates(spark, empty, monkeypatch):
    """Where no window of a level is repeated, no later level is counted; texts are returned as they are."""
    asked = []
    answers = substring_dedup.X.answers
    monkeypatch.setattr(substring_dedup.X, "answers", lambda rows, level, exact: (asked.append((level, exact)), answers(rows, level, exact))[1])
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100)), "en", "s") for i in range(5)] + [(None, None, "en", "s")]
    out = substring_dedup.remove_repeats(documents(spark, rows), 35).collect()
    assert asked == [(0, False)] and all(r.n_removed == 0 and not r.removed for r in out)
    assert sorted(key((r.doc_id, r.kept_text)) for r in out) == sorted(key((i, t or "")) for i, t, *_ in rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_last_level_compares_128_bits(monkeypatch, docs, rows):
    """With first halves that all collide, the second halves still tell windows apart."""
    monkeypatch.setattr(substring_dedup, "levels", lambda window, base: [window])
    plain = substring_dedup.window_hashes
    c = substring_dedup._Chunk([len(t.encode()) for t in ("a b c", "a b d", "a b c")], b"a b c\na b d\na b c")
    at = np.array([0, 3, 6])
    second = c.seconds(3, at)
    keys, many, halves = substring_dedup.X.distinct(np.zeros(3, np.uint64), second)
    assert second[0] == second[2] != second[1] and len(keys) == 2 and sorted(many.tolist()) == [False, True] and len(halves) == 2
    assert (second != plain(c.hashes, 3, seed=3)[at]).all()


@pytest.mark.parametrize("buckets", [1, 2, 7, 1000, 1 << 20])
def test_buckets_of_keys(buckets):
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64))
    keys[-1], keys[0] = 2**64 - 1, 0
    used, at = substring_dedup.X.edges(keys, buckets)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(used) > 0).all() and used[-1] == buckets - 1 and used[0] == 0
    assert all(((int(k) >> 32) * buckets) >> 32 == u for u, a, b in zip(used.tolist(), at, at[1:]) for k in keys[a:b][:3])


# --- 2


def test_language_id(docs, rows, empty):
    out = {r.doc_id: r for r in language_id.identify(docs).collect() if r.doc_id is not None}
    assert len(out) == len({r[0] for r in rows}) - 1
    for i, text, lang, _ in rows:
        if i is None:
            continue
        r = out[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif lang and len(text) > 80 and i < 300 and i % 7:  # every seventh text has an English passage
            assert r.lang_pred == lang and not r.rejected
    assert language_id.identify(empty).count() == 0
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {300, 301, 302, 303}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_id_rejects(spark, rows):
    """Labelled texts without letters do not switch rejection off."""
    rng = random.Random(5)
    letters = {"ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5200), "ar": range(0x627, 0x64A), "el": range(0x3B1, 0x3CA), "ja": range(0x3042, 0x3093), "latin": range(97, 123)}
    odd = [" ".join("".join(chr(rng.choice(x)) for _ in range(rng.randrange(2, 9))) for _ in range(n)) for x in letters.values() for n in (20, 300)]
    odd += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ", "x1q9z 4k2j " * 50]
    empty = [(600 + i, ("", " ", "12 ...")[i % 3], lang, "src0") for i, lang in enumerate(["en", "de", "fr"] * 10)]
    known = [r for r in rows if r[0] is not None and r[0] < 300]
    out = {r.doc_id: r for r in language_id.identify(documents(spark, known + empty + [(500 + i, t, None, "src0") for i, t in enumerate(odd)])).collect()}
    assert all(out[500 + i].rejected for i in range(len(odd)))
    assert not any(out[i].rejected for i, text, _, _ in known if len(text) > 20)
    counts, langs = language_id.n_gram_counts([r[1] for r in known if r[2]]), [r[2] for r in known if r[2]]
    none = np.zeros((len(empty), counts.shape[1]), np.float32)
    assert np.array_equal(language_id.fit(counts, langs).floors, language_id.fit(np.concatenate((counts, none)), langs + [r[2] for r in empty]).floors)


def test_language_id_rejects_other_languages_of_one_script(spark):
    """Learned from the driver's English, German, French and Spanish: other languages in Latin letters are too far from
    every centroid, held-out documents are not."""
    foreign = [
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência.",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
        "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama.",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    out = language_id.predict(docs.select("doc_id", "text").unionByName(more), model).collect()
    assert all(r.rejected for r in out if r.doc_id < 0)
    held = [r for r in out if r.doc_id >= 0 and r.held_out and r.lang_pred != "und"]
    assert len(held) > 30 and not any(r.rejected for r in held)


def test_language_id_counts_whole_texts():
    """A text beyond the piece size counts like its parts."""
    text = "abc déf " * (language_id.PIECE // 4)
    one, many = language_id.n_gram_counts([text])[0], language_id.n_gram_counts(["abc déf "])[0]
    assert np.array_equal(one, many * (language_id.PIECE // 4))


def plain_counts(text):
    """Bigrams and trigrams of letters, one by one; a run of other characters is the end of a word."""
    low = ["", "", *(c if c.isalpha() else "" for c in text.lower()), ""]
    out = [0.0] * language_id.DIMENSIONS

    def add(*pairs):
        x = 0
        for c, factor in pairs:
            x ^= (ord(c) if c else 0) * factor % 2**32
        out[(x ^ x >> 15) * 0x2C1B3C6D % 2**32 >> 20] += 1

    for a, b, c in zip(low, low[1:], low[2:]):
        if b:
            add((a, 0x9E3779B1), (b, 0x85EBCA77), (c, 0xC2B2AE3D))
        if b or c:
            add((b, 0x27D4EB2F), (c, 0x165667B1))
    return out


def plain_fit(counts, langs, clusters=4, rounds=12, seed=7):
    """Texts as dicts of weights; each language's k-means with the same first centroids, cosines term by term."""
    n = len(counts)
    idf = {d: math.log((1 + n) / (1 + sum(c[d] > 0 for c in counts))) + 1 for d in range(language_id.DIMENSIONS) if any(c[d] for c in counts)}

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values()))
        return {d: x / size for d, x in v.items()} if size else {}

    def vector(c):
        return unit({d: math.log1p(c[d]) * idf.get(d, math.log(1 + n) + 1) for d in range(len(c)) if c[d]})

    def cosine(a, b):
        return sum(x * b.get(d, 0.0) for d, x in a.items())

    random_, centroids = np.random.default_rng(seed), []
    for lang in sorted(set(langs)):
        own = [vector(c) for c, x in zip(counts, langs) if x == lang]
        mine = [own[i] for i in random_.permutation(len(own))[:clusters]]
        for _ in range(rounds):
            groups = [[] for _ in mine]
            for v in own:
                near = [cosine(v, c) for c in mine]
                groups[near.index(max(near))].append(v)
            mine = [unit({d: sum(v.get(d, 0.0) for v in g) for d in set().union(*g)}) if g else c for g, c in zip(groups, mine)]
        centroids += [(lang, c) for c in mine]
    return vector, cosine, centroids


def test_language_id_is_nearest_centroid(rows):
    """Against a plain version: the same n-grams, centroids, labels and scores."""
    texts = [(r[1], r[2]) for r in rows if r[0] is not None and r[0] < 60 and r[1]]
    counts = language_id.n_gram_counts([t[:400] for t, _ in texts])
    plain = [plain_counts(t[:400]) for t, _ in texts]
    assert np.array_equal(counts, np.array(plain, np.float32))
    known = [i for i, (_, lang) in enumerate(texts) if lang][:30]
    model = language_id.fit(counts[known], [texts[i][1] for i in known])
    vector, cosine, centroids = plain_fit([plain[i] for i in known], [texts[i][1] for i in known])
    names, scores, _ = model.predict(counts)
    assert [model.languages[o] for o in model.owner] == [lang for lang, _ in centroids]
    for c, name, score in zip(plain, names, scores):
        near = [(cosine(vector(c), x), lang) for lang, x in centroids]
        best, lang = max(near, key=lambda x: x[0])
        assert score == pytest.approx(best, abs=1e-5)
        assert name == lang or score - max(s for s, x in near if x != lang) < 1e-5


def test_unlabelled(spark):
    out = language_id.identify(documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.rejected) for r in out] == [("und", True)]


# --- 3


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_copies(docs, capacity=4).collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r[1] or ""), []).append(r)
    want = []
    for body, members in groups.items():
        order = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        keep = order[0][0]
        for k, r in enumerate(order):
            want.append((r[0], keep, len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()))
    assert sorted(key(r) for r in got) == sorted(key(w) for w in want)
    kept = exact_dedup.drop_copies(docs, capacity=4)
    assert kept.columns == docs.columns and sorted(key((r.doc_id,)) for r in kept.collect()) == sorted(key((w[0],)) for w in want if w[3])
    assert exact_dedup.exact_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_directory_doubles(docs):
    rows = exact_dedup.keyed(docs)
    index = exact_dedup.build_index(docs, rows, capacity=4)
    cells = [r.cell for r in index.directory.orderBy("cell").collect()]
    assert len(set(cells)) == len(cells) <= 1 << index.depth  # empty cells have no bucket
    sizes = index.entries.groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 4 and index.depth >= 4
    assert len({r.local_depth for r in index.directory.collect()}) > 1  # only overfull buckets have split


def test_the_directory_decides_where_a_text_is_found(docs):
    """With two buckets exchanged in the directory, probes go to the wrong one and find nothing there."""
    rows = exact_dedup.keyed(docs)
    index = exact_dedup.build_index(docs, rows, capacity=4)
    buckets = sorted({r.bucket for r in index.directory.collect()})
    a, b = buckets[0], buckets[-1]
    there = {(r.address, r.sha) for r in index.entries.where(F.col("bucket").isin(a, b)).collect()}
    index.directory = index.directory.withColumn("bucket", F.when(F.col("bucket") == a, b).when(F.col("bucket") == b, a).otherwise(F.col("bucket")))
    found = exact_dedup.probe(rows, index).collect()
    assert {r.sha for r in found if r.slot is None} == {sha for _, sha in there}


@pytest.mark.parametrize("address", [lambda body: F.lit(0).cast("long"), lambda body: F.pmod(F.xxhash64(body), F.lit(3)), lambda body: F.shiftleft(F.length(body).cast("long"), 58)])
def test_colliding_addresses_chain(docs, rows, address):
    """Texts of one address hang in one chain and are told apart by their bytes."""
    got, want = (sorted(map(key, exact_dedup.exact_copies(docs, 4, *a).collect())) for a in ((address,), ()))
    assert got == want
    keyed = exact_dedup.keyed(docs, address)
    chains = exact_dedup.build_index(docs, keyed, 4, 2, address).entries.groupBy("bucket", "address").agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.countDistinct("sha").alias("n")).collect()
    assert all(r.slots == list(range(1, r.n + 1)) for r in chains) and max(r.n for r in chains) > 2
    same = [sorted((key((r.doc_id,)) for r in exact_dedup.drop_copies(docs, 4, *a).collect())) for a in ((address,), ())]
    assert same[0] == same[1]


def test_dropped_copies_of_clashing_names(spark):
    """Columns may be named as they like, repeated rows and null ids included."""
    rows = [(1, "a b", "x", 1, 2), (1, "a b", "y", 1, 2), (2, "ab", None, 1, 2), (None, "q", "x", 1, 2), (None, "q", "w", 1, 2), (3, None, "x", 1, 2), (4, "", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, n int, sha int")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns and sorted(map(key, got.collect())) == sorted(map(key, [rows[0], rows[4], rows[5]]))


# --- 4


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    bad = [(900, None), (950, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] + [0.0] * 5), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, block int, label int").repartition(4)
    for bits, block in ((2, 16), (6, 1000)):
        got = va_file.top_k(frame, frame.where("vec_id % 50 = 0"), 5, bits, block, 2).collect()
        assert sorted(map(tuple, got)) == brute.top_k(rows, 50, 5)
    few = frame.where("vec_id IN (0, 1, 2)")
    assert va_file.top_k(few, few.where("vec_id = 0"), 5).count() == 2
    assert va_file.top_k(frame.limit(0), frame.limit(0), 5).count() == 0 and va_file.top_k(frame, frame.limit(0), 5).count() == 0


@pytest.mark.parametrize("first", [1, 4])
def test_top_k_of_repeated_ids(spark, first):
    """Ids that occur often, with one vector or many, and vectors of several lengths."""
    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 0, *range(1, 40)]), [rng.choice([0.0, 0.5, 1.0, 2.0]) for _ in range(3)]) for _ in range(150)]
    rows += [(0, [2.0, 2.0, 2.0])] * 12 + [(1, [2.0, 2.0, 2.0])] * 3 + [(50, []), (7, []), (8, []), (100, [1.0]), (50, [3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = va_file.top_k(frame, frame.where("vec_id % 50 = 0"), 5, 2, 8, 2, first).collect()
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_vectors_are_read_in_rounds(spark, monkeypatch):
    """No candidate beyond a query's last round is read, and rounds go on until the kth score is certain."""
    rounds, frames = [], {}
    written = va_file.written

    def kept(df, name):
        rounds.append(name)
        frames[name] = written(df, name)
        return frames[name]

    monkeypatch.setattr(va_file, "written", kept)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for bits, least in ((1, 2), (8, 1)):
        rounds.clear()
        got = va_file.top_k(frame, frame.where("vec_id % 50 = 0"), 5, bits, 64, 4, 1).collect()
        assert sorted(map(tuple, got)) == brute.top_k(rows, 50, 5) and rounds.count("best") >= least
        assert frames["candidates"].count() < 8 * 400 * (0.2 if bits == 8 else 1.1)  # the floors leave few cells


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (9, 7))
    for bits in (1, 3, 8):
        codes, edges = va_file.cells(v, bits)
        low, high = va_file.bounds(q, codes, edges)
        exact = q @ v.T
        assert (low <= exact).all() and (exact <= high).all() and codes.max() < 1 << bits


# --- 5


@pytest.mark.parametrize(("width", "percent", "block", "fragments"), [(3, 90, 2048, 4), (5, 80, 2048, 3), (1, 50, 4, 2), (2, 60, 3, 5)])
def test_jaccard_join(docs, rows, width, percent, block, fragments, monkeypatch):
    monkeypatch.setattr(jaccard_join.set_links, "__defaults__", (fragments, block, 4_000_000 if block > 100 else 150))
    got = jaccard_join.similar(docs, width, percent).collect()
    distinct = {}
    for i, text, *_ in rows:  # a null doc_id has no place in the brute version: give it one that is never smallest
        distinct.setdefault(i if i is not None else 10**9, text)
    want = brute.jaccard_components(sorted(distinct.items()), width, percent)
    assert len(got) == len(rows)
    for r in got:
        n, component = want[r.doc_id if r.doc_id is not None else 10**9]
        assert (r.n_shingles, r.component_id) == (n, component)
    kept = jaccard_join.representatives(docs, width, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, (_, c) in want.items() if i == c and i < 10**9}


def test_representatives_of_null_and_repeated_ids(spark):
    """One row a group, whatever the ids; no unrelated document goes."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = {k: t + f" {k}x" for k, t in text.items()}
    rows = [(None, text["a"], "en", "s"), (None, near["a"], "en", "s"), (None, text["b"], "en", "s"), (3, near["b"], "en", "s")]
    rows += [(5, text["c"], "en", "s"), (5, near["c"], "en", "s"), (1, text["d"], "en", "s"), (7, near["d"], "en", "s"), (7, text["e"], "en", "s")]
    rows += [(9, text["f"], "de", "s"), (9, text["f"], "en", "s"), (10, near["f"], "en", "s"), (11, "", "en", "s"), (11, "", "en", "s"), (None, None, "en", "s")]
    out = [(r.doc_id, r.text, r.lang) for r in jaccard_join.representatives(documents(spark, rows)).collect()]
    assert [sum((r[1] or "")[:1] == k for r in out) for k in "abcdef"] == [1] * 6
    assert {(3, near["b"], "en"), (1, text["d"], "en"), (7, text["e"], "en"), (9, text["f"], "de")} <= set(out)
    assert sorted(key(r) for r in out if not r[1]) == sorted(map(key, [(11, "", "en"), (11, "", "en"), (None, None, "en")]))


def test_chained_group_in_blocks(spark, monkeypatch):
    """Sets of all sizes chained by common shingles: blocks of size bands leave no link out."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(400)]
    texts = []
    for i in range(60):
        n = rng.randrange(20, 400)
        words = common[:n]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(n)] = f"x{i}"
        texts.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join.set_links, "__defaults__", (2, 6, 1500))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(documents(spark, [(i, t, None, None) for i, t in texts]), 2, 80).collect()}
    want = brute.jaccard_components(texts, 2, 80)
    assert got == want and len({c for _, c in want.values()}) < 40


def test_jaccard_join_empty(empty):
    assert jaccard_join.similar(empty, 3, 90).count() == 0


def test_links_are_counted(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2]), " ".join(words), "other text of its own"]
    got = {r.doc_id: (r.component_id, r.class_size, r.links) for r in jaccard_join.similar(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)]), 3, 90).collect()}
    assert got == {0: (0, 2, 2), 1: (0, 1, 2), 2: (0, 1, 2), 3: (0, 2, 2), 4: (4, 1, 0)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# --- 6


def test_html():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site name, slogan</header>
    <nav><a href=/a>Home, sweet home</a></nav><div id="cookie-notice"><p>We use cookies, as all do, and so on and on.</p></div>
    <div class="layout with-sidebar"><article><h1>Head &amp; line</h1><p><b>First, long enough paragraph, with&nbsp;points.<br>next
    line<p>Second   one, also long enough, to count.<ul><li>item one<li>item two</ul><pre>code
    here</pre><div class="ad">Buy, buy, buy, and buy much more of it.</div><form>Name, please, and mail <input></form></article>
    <div class="comments"><p>I, as a reader, comment, and comment at length.</p></div>
    <aside>Other, related, stories, of no interest here.</aside></div><footer>&copy; us, all rights, reserved</footer>"""
    assert html_extract.extract(page) == "Head & line\n\nFirst, long enough paragraph, with points. next line\n\nSecond one, also long enough, to count.\n\nitem one\n\nitem two\n\ncode here"
    for odd in (None, "", "<", "<p", "<!-- <p>x</p>", "<script>x", "<div></div>", "<nav>a</nav>"):
        assert html_extract.extract(odd) in ("", "<", "<p")
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<p>a</p>" * 3) == "a\n\na\n\na"
    assert html_extract.extract("<div>" * 3000 + "deep text, deep") == "deep text, deep"


def long_paragraphs(n, size, word):
    return [f"{word}{i}, " + "text " * (size // 5) + "end" for i in range(n)]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<main><nav>Menu, of the site</nav><article>{}</article></main>", "<div id=content>{}</div>", "{}", "<main><div><div>{}</div></div></main>"])
@pytest.mark.parametrize("deep", [False, True])
def test_html_unequal_sections(frame, deep):
    """All of an article stays, however unequal its containers are."""
    first, second, third = long_paragraphs(10, 400, "a"), long_paragraphs(2, 300, "b"), ["Short."]
    sections = "".join(f"<section><h2>Head {k}</h2>{'<div>' * deep}{''.join(f'<p>{p}</p>' for p in ps)}{'</div>' * deep}</section>" for k, ps in enumerate((first, second, third)))
    rest = "<h4>Four</h4><table><tr><td>Cell</td></tr></table><dl><dt>Term</dt><dd>Meaning</dd></dl><figure><figcaption>Caption</figcaption></figure><div>Brief</div>Bare text"
    links = "<div><a href=/1>Other, story</a> <a href=/2>One, more</a></div>" if "<article>" not in frame else ""
    want = ["Head 0", *first, "Head 1", *second, "Head 2", *third, "Four", "Cell", "Term", "Meaning", "Caption", "Brief", "Bare text"]
    assert html_extract.extract("<body>" + frame.format(sections + rest + links) + "</body>").split("\n\n") == want


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='main-content no-sidebar'>{}</div>", "{}"])
def test_html_names_of_articles(frame):
    """Slug ids and names of what an article is about cost none of its text."""
    first, second = long_paragraphs(3, 300, "a"), long_paragraphs(2, 200, "b")
    page = f"""<h2 id="related-work">Related work</h2>{"".join(f"<p>{p}</p>" for p in first)}<h2 id="how-to-search-files">Files</h2><p class="notice-period">Notice of a month.</p>
    <section id="discussion"><h3 id="comments">Comments</h3>{"".join(f"<p>{p}</p>" for p in second)}</section><section id="search-engines"><p>Of engines.</p></section>
    <div class="section" id="feedback"><p id="footer">Of feedback.</p></div><div class="section" id="comments"><p>Of comments.</p></div><div id="how-to-share-files"><p>Of files, shared.</p></div><p>A <span class="related">related</span> word.</p>"""
    off = """<div class="ad">Buy, buy.</div><div class="share-links"><a href=/t>Tell, a friend</a></div><div id="related"><a href=/o>Other, story</a></div><ul class="post-comments"><li>I comment, too.</ul>"""
    want = ["Related work", *first, "Files", "Notice of a month.", "Comments", *second, "Of engines.", "Of feedback.", "Of comments.", "Of files, shared.", "A related word."]
    assert html_extract.extract("<body>" + frame.format(page + off) + "</body>").split("\n\n") == want
    h1 = '<h1 id="search-engines">Engines</h1>'
    assert html_extract.extract("<body>" + frame.format(h1 + page + off) + "</body>").split("\n\n") == ["Engines", *want]


def test_html_beside_an_article():
    text = "".join(f"<p>{p}</p>" for p in long_paragraphs(3, 300, "a"))
    page = f"<body>Slogan<div>Brief</div><h1>Title</h1><article>{text}<ul><li><a href=/r>Reference, linked</a></ul></article><div>Notes, few</div></body>"
    assert html_extract.extract(page).split("\n\n") == ["Title", *long_paragraphs(3, 300, "a"), "Reference, linked"]


def test_html_scores_by_definition():
    """Each paragraph's points walked up to the root, halved at every step after the first."""
    rng = random.Random(2)
    for _ in range(30):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "<section>", "</section>", "<ul><li>", "</ul>", "<b>", "</b>", "<td>", f"{'word, ' * rng.randrange(30)}text", "<nav>menu, menu, and a menu of menus</nav>"]) for _ in range(60))
        root = html_extract.parse(page)
        order = html_extract._measure(root, True)
        want = dict.fromkeys(map(id, order), 0.0)
        for node in order:
            own = []
            html_extract._inline(node, True, own)
            text = " ".join("".join(own).split())
            if node.tag in html_extract.BLOCK and node.parent is not None and len(text) >= 25:
                points, up = 1 + text.count(",") + min(len(text) / 100, 3), node.parent
                while up is not None:
                    want[id(up)] += points
                    points, up = points / 2, up.parent
        scored = html_extract._score(order, True, 25)
        assert all(n.score == pytest.approx(want[id(n)]) for n in order) and {id(n) for n in scored} == {i for i, x in want.items() if x}


def test_html_open_elements():
    """Unclosed and stray elements end where they should."""
    cases = {
        "<p>a<p>b<div>c<p>d</div>e": ["a", "b", "c", "d", "e"],
        "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>": ["a", "b", "c", "d"],
        "<table><tr><td>a<td>b<tr><th>c<tbody><tr><td>d</table>e": ["a", "b", "c", "d", "e"],
        "<dl><dt>a<dd>b<dt>c</dl>": ["a", "b", "c"],
        "<i>a<div>b</i>c</div>d</i>": ["a", "bc", "d"],
        "<b>a</i></b></b></div>b": ["ab"],
    }
    for page, want in cases.items():
        assert html_extract.extract(f"<main>{page}</main>").split("\n\n") == want


@pytest.mark.parametrize("page", ["<div>" * 30_000, "<div><h1>a</h1>" * 10_000, "<div><article><p>a, b" * 8_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<li><ul><div>" + "<div>" * 20_000 + "<li>a</li>" * 20_000, "<b>" * 20_000 + "<p>a</p>" * 20_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html_extract.extract(page + "deep text, deep")
    assert time.process_time() - began < 5


def test_html_heading_of_an_entry():
    text = "".join(f"<p>{p}</p>" for p in long_paragraphs(3, 300, "a"))
    for frame in ("<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>"):
        page = frame.format(f'<div class="entry-header"><h2>Heading</h2></div>{text}<div><p>Short end one.</p></div>')
        assert html_extract.extract(f"<body>{page}</body>").split("\n\n") == ["Heading", *long_paragraphs(3, 300, "a"), "Short end one."]


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text, here</p></article>", "x"), (2, None, None, "y"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.url, r.text) for r in html_extract.extract_pages(pages).collect()} == {(1, "u", "Some text, here"), (2, None, ""), (None, "u", "")}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# --- 7


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    got = packing.pack(docs, path, 256, 2, 3000).collect()
    lengths, covered = {}, {}
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {i: sum(r[0] == i for r in rows) for i in ids}
    assert covered == {i: len(x) * copies[i] for i, x in ids.items()}
    for pieces in lengths.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end == 256 or end < 256 and end & (end - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_balance():
    pieces = packing.balance([10, 700, 3, 60, 60, 0], 100)
    assert sum(n for _, _, n, _ in pieces) == 833
    assert packing.capacities(833, 100) == [100] * 8 + [32, 1]
    loads = {}
    for _, _, n, at in pieces:
        loads[at] = loads.get(at, 0) + n
    assert [loads[i] for i in range(10)] == packing.capacities(833, 100)


def test_word_tokenizer_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = packing.WordTokenizer(path, max_words=6)
    texts = ["", "   ", "é é x́", "it's I'LL <|endoftext|>x a<|startoftext|> \x01 q", " a\x1cb 12³ ½ Ⅷ ΑΣ ΣΑΣ İx ſ ﬁ", "́ ́a 𝔘𝕏 한국어 日本 \x00\x7f", "word " * 20 + "other,word!! 77"]
    for _ in range(2):
        got = t.encode([x.encode() for x in texts], 2)
        assert [g.tolist() for g in got] == [[*t.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_long_texts_are_cut_at_white_space():
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [b"", b"one two\tthree " * 50 + b"w" * 90 + b" four", b"x" * 300, b" " * 70]
    for size in (7, 64, 1000):
        assert all(b"".join(packing.pieces(x, size)) == x for x in texts)
        assert [g.tolist() for g in t.encode(texts, 2, size)] == [g.tolist() for g in t.encode(texts, 2)]


def test_balance_is_cheapest_with_room():
    """Against a plain version: the cheapest sequence with room, else the largest room, is taken at every step."""
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.choice([0, 1, 3, 50, 90, 250]) + rng.randrange(20) for _ in range(rng.randrange(1, 40))]
        size = rng.choice([16, 100])
        room = packing.capacities(sum(lengths), size)
        cost, want = [0.0] * len(room), []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            start = 0
            while start < lengths[i]:
                left = lengths[i] - start
                able = [k for k in range(len(room)) if room[k] >= left] or [k for k in range(len(room)) if room[k] == max(room)]
                at = min(able, key=lambda k: (cost[k], k))
                n = min(left, room[at])
                want.append((i, start, n, at))
                room[at], cost[at], start = room[at] - n, cost[at] + n + n * n / 1024, start + n
        assert packing.balance(lengths, size) == want


def test_repeated_rows_are_dealt_to_all_shards(spark):
    docs = spark.createDataFrame([(7, "the same text of a few words")] * 200, "doc_id long, text string")
    shards = packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 700).groupBy("shard").count().collect()
    assert len(shards) > 2 and max(r["count"] for r in shards) <= 100


def test_array_bpe_is_the_tokenizer():
    from bitweave.llm.bpe import ArrayBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = ArrayBpe(path), packing.WordTokenizer(path)
    assert own.usable and not ArrayBpe(public_tokenizers.path("byte_bpe_50k.json")).usable
    rng = random.Random(5)
    words = ["".join(rng.choice("abcABCzZ019.,!-<>|&%$#*éÉßÿÀüaaabbb×÷ñ'") for _ in range(rng.randrange(1, 14))).encode() for _ in range(5000)]
    words += [b"aaaaaaa", b"!!!!!!!!!!!", "éééééé".encode(), b"<|endoftext|>x", "日本".encode(), b"\x00"]
    ids, sizes, handled = own.encode(words)
    for word, mine, use in zip(words, np.split(ids, np.cumsum(sizes)[:-1]), handled):
        if use:
            assert mine.tolist() == t.tokenizer.encode(word.decode(), add_special_tokens=False).ids, word
    assert 0.3 < handled.mean() < 1 and not handled[-3:].any()


# --- 8


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "ü" * 700, "<p>" + "b" * 1500
    rows = [(1, "http://a/1", big), (7, "http://a/7?x=%20 y\r\n", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (9, "v", other), (None, "n", big), (None, "n", big), (None, None, "z" * 1000), (None, "u", "z" * 1000), (10, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, digest int").repartition(3)
    got = warc.round_trip(pages, archive_bytes=600).collect()
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        top = max((r[0] for r in rows if r[2] == html and r[0] is not None), default=None)
        revisit = len(raw) >= 1000 and i != top
        want.append((i, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    for at in [k for k, w in enumerate(want) if w[0] == 9][1:]:
        want[at] = (*want[at][:4], "revisit", 9)  # of the repeated rows one is the response
    at = next(k for k, w in enumerate(want) if w[:3] == (None, "u", 1000))
    want[at] = (*want[at][:4], "revisit", None)  # no row has a page_id: that with the smallest url, null, is the response
    assert sorted(key((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(key, want))
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    data = warc.package([("a", b"one"), ("b", b"three")], zip64)
    found = warc.members(lambda at, n: data[at : at + n], len(data))
    assert set(found) == {"archive/data.warc.gz", "indexes/index.jsonl"}
    at, n = found["archive/data.warc.gz"]
    assert data[at : at + n] == b"onethree" == zipfile.ZipFile(io.BytesIO(data)).read("archive/data.warc.gz")


def test_zip64_end_record():
    """Central directory counts and offsets from the ZIP64 records, with a comment after them."""
    import struct

    data = warc.package([("a", b"one")])
    end = data.rfind(b"PK\x05\x06")
    count, length, offset = struct.unpack("<HII", data[end + 10 : end + 20])
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    wide = data[:end] + end64 + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"hello"
    assert warc.members(lambda at, n: wide[at : at + n], len(wide)) == warc.members(lambda at, n: data[at : at + n], len(data))


def test_end_record_named_in_its_comment():
    """A comment may hold the end record's signature."""
    data = warc.package([("a", b"one")])
    comment = b"PK\x05\x06" + b"\x00" * 30
    longer = data[:-2] + len(comment).to_bytes(2, "little") + comment
    assert warc.members(lambda at, n: longer[at : at + n], len(longer)) == warc.members(lambda at, n: data[at : at + n], len(data))


def test_compressed_member_is_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", "a" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError, match="stored"):
        warc.members(lambda at, n: data[at : at + n], len(data))
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(gzip.compress(b"x")[:-3])


# --- 9


RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/?q": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es": ("x.net", "/es", None, "allow"),
        "http://x.net/es/#a?b": ("x.net", "/es/", "net/es/", "block"),
        "ftp://x.com?y/z": ("x.com", "", None, "allow"),
        "http://x.com#/en/": ("x.com", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://ÄX.com/É": ("Äx.com", "/É", "com/", "allow"),
    }
    rows = [(i, u, None, "c") for i, u in enumerate(urls)] + [(99, None, None, "c"), (99, None, None, "c")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == (urls[r.url] if r.url is not None else ("", "", None, "allow"))


def test_url_aliases(spark):
    canonical = '<head><!-- <link rel=canonical href="http://no.net/es/"> --><LINK href="{}" rel="Canonical"></head>'
    rows = [
        (1, "http://a.org/1", canonical.format("/2")),
        (2, "http://a.org/2#f", '<meta http-equiv="Refresh" content="0; url=http://x.net/es/1">'),
        (3, "https://X.net/es/1", None),  # blocked by its rule
        (4, "http://y.com/en/", canonical.format("http://x.net/es/1")),  # allowed by its rule
        (5, "http://b.org/", canonical.format("http://c.org/")),
        (6, "http://d.org/", "<a href=http://x.net/es/1>link</a>"),
        (7, "http://e.org/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://e.org/", "http://f.org/"), ("http://f.org/", "http://q.example.com/en/")], "url string, target string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, RULES, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_classes_against_brute_force(spark):
    """Random links and redirects: every class with a blocked url is blocked, but for urls that a rule allows."""
    rng = random.Random(8)
    hosts = ["a.org", "b.org", "c.net", "x.net", "m.com", "q.example.com", "www.example.com", "com"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'fr/', ''])}{i % 40}{rng.choice(['', '?q=1', '#f'])}" for i in range(160)]
    rows = [(i, u, f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.3 else "<p>text</p>") for i, u in enumerate(urls)]
    redirects = [(rng.choice(urls), rng.choice(urls)) for _ in range(40)] + [(None, urls[0]), (urls[1], "no url")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, spark.createDataFrame(redirects, "url string, target string")).collect()}

    def parts(u):
        host, _, rest = u.split("://", 1)[1].partition("/")
        path = "/" + rest if rest or u.split("://", 1)[1].endswith("/") else ""
        return host.split("?")[0].split("#")[0].lower(), re.split("[?#]", path)[0], u.split("#")[0].partition("?")[1:]

    def own(u):
        host, path, _ = parts(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(u, re.search('href="([^"]*)"', h)[1]) for _, u, h in rows if "href" in h] + [x for x in redirects if x[0] and "://" in x[1]]
    for a, b in links:
        parent[find(parts(a))] = find(parts(b))
    blocked = {find(parts(u)) for u in urls if own(u) and own(u).verdict == "block"}
    carried = 0
    for i, u in enumerate(urls):
        rule = own(u)
        want = rule.verdict if rule else "block" if parts(u) in parent and find(parts(u)) in blocked else "allow"
        carried += want == "block" and rule is None
        assert got[i] == (rule.name if rule else None, want), u
    assert carried > 3


# --- 10


def brute_mix(rows, domain, targets):
    leaves = {}
    for r in rows:
        n = len(brute.WORD.findall(r[1] or ""))
        leaves.setdefault((domain(r), r[2] or "none", r[3] or "none"), []).append((r, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items() if sum(n for _, n in v)}
    return leaves, tokens, brute.tree_budgets(tokens, targets.weights, targets.default, targets.budget_share, targets.max_epochs)


def draws(spark, epochs, docs):
    """{(epoch, doc_id, text of a row without one): draw}"""
    frame = spark.createDataFrame(sorted({(i, t if i is None else None) for i, t in docs}, key=key), "i long, t string")
    who = F.when(F.col("i").isNull(), F.xxhash64("t"))
    return {(e, r.i, r.t): r.u for e in range(epochs) for r in frame.select("i", "t", mixing.draw(17, F.lit(e), F.col("i"), who).alias("u")).collect()}


@pytest.mark.parametrize(("share", "per_bucket"), [(0.5, 1000), (0.5, 2), (3.0, 5), (0.05, 1), (100.0, 1000), (0.0, 1000)])
def test_mixing(spark, docs, rows, share, per_bucket):
    targets = mixing.Targets({("a",): 2.0, ("b",): 1.0, ("a", "fr"): 0.0}, budget_share=share, max_epochs=3)
    domain = F.when(F.col("source") == "src0", "a").otherwise("b")
    got = mixing.mix(docs, domain, targets, per_bucket=per_bucket)
    assert got.columns == [*docs.columns, "_domain", "_tokens", "_epoch"]
    got = got.collect()
    leaves, tokens, budget = brute_mix(rows, lambda r: "a" if r[3] == "src0" else "b", targets)
    draw = draws(spark, 4, [r[:2] for r in rows])

    def place(epoch, m):
        return draw[epoch, m[0][0], m[0][1] if m[0][0] is None else None]

    want = []
    for leaf, members in leaves.items():
        if not budget.get(leaf):
            continue
        whole, rest = divmod(budget[leaf], tokens[leaf])
        want += [(r[0], leaf[0], n, e) for r, n in members for e in range(whole)]
        ordered = sorted(members, key=lambda m: place(whole, m))
        total, k = 0, 0
        while rest and k < len(ordered):
            same = [m for m in ordered if place(whole, m) == place(whole, ordered[k])]
            if total + sum(n for _, n in same) > rest:
                break
            total, k = total + sum(n for _, n in same), k + len(same)
        want += [(r[0], leaf[0], n, whole) for r, n in ordered[:k]]
    assert sorted(key((r.doc_id, r._domain, r._tokens, r._epoch)) for r in got) == sorted(map(key, want))


@pytest.mark.parametrize("seed", range(4))
def test_leaf_budgets(spark, seed):
    rng = random.Random(seed)
    tokens = {(rng.choice("ab"), rng.choice("xyz"), str(i)): int(rng.paretovariate(0.7)) + 1 for i in range(300)}
    targets = mixing.Targets({("a",): 2.0, ("b", "x"): 0.0, ("a", "y"): 0.25, **{k: rng.choice([0.0, 0.5, 4.0]) for k in list(tokens)[:40]}}, budget_share=(0.05, 0.5, 2.0, 9.0)[seed], max_epochs=3)
    got = mixing.leaf_budgets(spark.createDataFrame([(*k, n) for k, n in tokens.items()], "d string, l string, s string, tokens long"), ["d", "l", "s"], targets)
    want = brute.tree_budgets(tokens, targets.weights, targets.default, targets.budget_share, targets.max_epochs)
    assert {(r.d, r.l, r.s): r._budget for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_many_leaves(spark, monkeypatch):
    """100,000 leaves, most of them children of one parent, summed range by range."""
    monkeypatch.setattr(mixing, "RANGE", 20_000)
    leaves = spark.range(100_000).selectExpr("if(id % 10 < 8, 'a', 'b') AS d", "'x' AS l", "CAST(id AS STRING) AS s", "1 + id % 7 AS tokens")
    got = mixing.leaf_budgets(leaves, ["d", "l", "s"], mixing.Targets({("a",): 1.0, ("b",): 3.0}, budget_share=0.3, max_epochs=1)).collect()
    tokens = {("ab"[i % 10 >= 8], "x", str(i)): 1 + i % 7 for i in range(100_000)}
    want = brute.tree_budgets(tokens, {("a",): 1.0, ("b",): 3.0}, 1.0, 0.3, 1)
    assert {(r.d, r.l, r.s): r._budget for r in got} == {k: n for k, n in want.items() if n}


def test_mixing_of_clashing_names_and_null_ids(spark):
    """Columns named like ours are passed on; rows without doc_id are drawn by their texts."""
    rows = [(None if i % 2 else i, f"text number {i}", "en", "s", "mine", i, "x", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _domain string, _tokens long, __domain string, _part int")
    out = mixing.mix(docs, F.lit("a"), mixing.Targets(budget_share=0.5, max_epochs=1), per_bucket=10)
    assert out.columns == [*docs.columns, "___domain", "__tokens", "_epoch"]
    got = out.collect()
    assert all(r["_domain"] == "mine" and r["___domain"] == "a" and r["__tokens"] == 3 and r.text == f"text number {r['_tokens']}" for r in got)
    assert len(got) == 100 and 30 < sum(r.doc_id is None for r in got) < 70


def test_mixing_empty(empty):
    assert mixing.mix(empty, F.lit("a"), mixing.Targets()).count() == 0


@pytest.mark.parametrize(
    ("tokens", "targets", "want"),
    [
        ({("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000}, mixing.Targets(budget_share=0.1, max_epochs=1), {"1": 10, "2": 66, "3": 75, "4": 150}),
        ({("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "x", "4"): 1000}, mixing.Targets({("b",): 0.0}, budget_share=1.0, max_epochs=1), {"1": 10, "2": 1000, "3": 1000}),
        ({("a", "x", "1"): 100, ("a", "x", "2"): 100, ("a", "x", "3"): 100}, mixing.Targets(budget_share=0.0334, max_epochs=1), {"1": 4, "2": 3, "3": 3}),
        ({("a", "x", "1"): 2, ("a", "x", "2"): 100}, mixing.Targets(budget_share=0.1, max_epochs=1), {"1": 2, "2": 8}),
    ],
)
def test_shortages_stay_among_siblings(spark, tokens, targets, want):
    got = mixing.leaf_budgets(spark.createDataFrame([(*k, n) for k, n in tokens.items()], "d string, l string, s string, tokens long"), ["d", "l", "s"], targets)
    assert {r.s: r._budget for r in got.collect()} == want


# --- helpers


def test_word_split_matches_the_pattern(rows):
    for _, text, *_ in rows:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        a, b = common.word_bounds(buf)
        assert [bytes(buf[i:j]).decode() for i, j in zip(a, b)] == brute.WORD.findall(text or "")


def test_window_hashes():
    words = np.array([5, 7, 5, 7, 9, 5, 7], np.uint64)
    h = common.window_hashes(words, 2)
    assert len(h) == 6 and h[0] == h[2] == h[5] and len(set(h.tolist())) == 4
    assert len(common.window_hashes(words, 8)) == 0
