"""Small cases of every corpus operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import webp_writer
from tallyforge.llm import graph, html_text, language, line_dedup, media, mixing, near_dedup, packing, pii, quality, topk, webp
from tallyforge.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, h string"
ROWS = [
    (1, "Ann went home.\nShared line\nlast", "en", "s1", 30, "k", "x"),
    (1, "Ann went home.\nShared line\nlast", "en", "s1", 30, "k", "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "s2", 0, "", ""),
    (4, "SHARED LINE \n\n\t shared line", "fr", "s1", None, "a", "b"),
    (None, "shared line\nno id", "fr", "s3", 5, "a", "b"),
    (5, "word " * 30_000 + "é😀 " + "1 " * 20_000, "de", "s1", 9, "a", "b"),
    (6, "shared line", "en", "s1", 11, "a", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns named as those the operators make for themselves.
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- packing


def test_packing_lays_every_id_once(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path())
    rows = packing.pack_documents(docs, path()).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (own[0].window == 4096 or own[0].window == at)
    for doc_id, n in ((1, 2), (2, 1), (5, 1)):
        text = next(r[1] for r in ROWS if r[0] == doc_id) or ""
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == n * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack_documents(nothing, path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("'s'tİſ\x1c\x85\xa0½²ªº·_<|endoftext|>éΣ日あ😀́"))))
def test_word_ids_are_the_librarys(text):
    words = packing.word_ids(path())
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 90))
def test_closest_fill_is_the_best(lengths, capacity):
    counts = np.bincount(lengths, minlength=100)
    use = packing.closest_fill(sorted(set(lengths), reverse=True), counts, capacity)
    best = {0}
    for n in lengths:
        best |= {b + n for b in best if b + n <= capacity}
    assert sum(n * k for n, k in use.items()) == max(best) and all(k <= counts[n] for n, k in use.items())


# ---------------------------------------------------------------- lines, languages, quality


@pytest.mark.parametrize("few", [False, True])
def test_line_dedup(docs, nothing, monkeypatch, few):
    if few:
        # More common lines than are sent to the tasks: they are joined.
        monkeypatch.setattr(line_dedup, "COMMON", 0)
    got = line_dedup.drop_common_lines(docs, min_docs=3)
    assert got.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    kept = {r.doc_id: (r.text, r._n_lines, r._n_dropped, r._key) for r in got.collect()}
    assert kept[1] == ("Ann went home.\nlast", 3, 1, "k") and got.where("doc_id = 1").count() == 2
    assert kept[2][:3] == ("", 1, 0) and kept[3][:3] == ("", 1, 0)
    assert kept[4][:3] == ("", 3, 2) and kept[None][:3] == ("no id", 2, 1) and kept[6][:3] == ("", 1, 1)
    # Three documents have it; a repeated row and one without id don't count.
    assert line_dedup.drop_common_lines(docs, min_docs=4).where("_n_dropped > 0").count() == 0
    assert line_dedup.drop_common_lines(nothing).count() == 0


def test_language(spark, docs, nothing):
    teach = [(i, " ".join(w[(i * k) % len(w)] for k in range(1, 40)), lang) for lang, w in (("a", ["thing", "other", "with"]), ("b", ["der", "nicht", "schön"])) for i in range(1, 30)]
    model = language.learn(spark.createDataFrame(teach, "doc_id long, text string, lang string"))
    assert [p[0] for p in model.predict(["other thing", "NICHT schön", None, "12 !?", "", "thing with"])] == ["a", "b", "und", "und", "und", "a"]
    got = language.identify(docs, model)
    assert got.count() == len(ROWS) and {r._lang_pred for r in got.where("text is null or text = ''").collect()} == {"und"}
    assert got.where("_lang_score < 0 or _lang_score > 1").count() == 0
    assert language.identify(nothing, language.learn(nothing)).count() == 0
    assert language.learn(nothing).predict(["text"]) == [("und", 0.0)]


def test_every_language_and_letter_is_learned(spark):
    # 70 languages: pairs share a script of 40 letters and differ in its order; the rarer half has two documents each.
    rng = np.random.default_rng(5)
    words = {f"l{i}": ["".join(chr(0x4E00 + 40 * (i // 2) + c) for c in rng.integers(0, 40, 4)) for _ in range(12)] for i in range(68)}
    words |= {"high": ["".join(chr(0x10400 + c) for c in rng.integers(0, 40, 4)) for _ in range(12)], "greek": ["ΛΌΓΟΣ", "ΦΊΛΟΣ", "ΝΌΜΟΣ"]}
    text = lambda lang, n=60: " ".join(rng.choice(words[lang], n))
    teach = [(100 * k + i, text(lang), lang) for k, lang in enumerate(words) for i in range(8 if k < 35 else 2)]
    model = language.learn(spark.createDataFrame(teach, "doc_id long, text string, lang string"))
    assert model.langs == sorted(words)
    assert [model.predict([text(lang, 20).lower()])[0][0] for lang in words] == list(words)
    letters = set("".join(sum(words.values(), [])).lower())
    assert len({int(model.symbols.codes[ord(c)]) for c in letters}) == len(letters)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80))
def test_displaced_edges_are_the_automatons(codes):
    edges = language.automaton(np.array(codes))
    place, table = language.displaced(edges, 7)
    assert len(set(place.tolist())) == len(edges)
    for s, out in enumerate(edges):
        for c in range(7):
            source, target = table[place[s] + c]
            assert (source == place[s]) == (c in out) and (c not in out or target == place[out[c]])


@settings(max_examples=40, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.text("abcd ", min_size=1, max_size=400))
def test_phrases_are_greedy_longest_matches(known, text):
    model = language.Model({"x": [known.replace(" ", "") or "a"]})
    learned = model.symbols.encode(known.replace(" ", "") or "a").tolist()[: language.LEARN_CHARS]
    codes = model.symbols.encode(text)
    if not len(codes):
        return
    inside = {tuple(learned[i:j]) for i in range(len(learned)) for j in range(i, len(learned) + 1)}
    want = 0
    for lo in range(0, len(codes), language.STRETCH):
        part, at = codes[lo : lo + language.STRETCH].tolist(), 0
        phrase = []
        for c in part:
            if tuple(phrase + [c]) in inside:
                phrase.append(c)
            else:
                want += 1
                phrase = [c] if (c,) in inside else []
        want += 1
    assert model.phrases([codes])[0][0] == want


def test_quality(spark, docs, nothing):
    good, bad = "the quiet river ran past old mills and green fields in spring", "BUY!! NOW!! CHEAP!! BUY!! NOW!!"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(300)]
    labels = [(i, i % 2) for i in range(200)]
    model = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"))
    scores = model.scores([good, bad, None, ""])
    assert scores[0] > 0.8 > 0.3 > scores[1] and scores[2] == scores[3]
    got = quality.score(docs, model)
    assert got.count() == len(ROWS) and got.columns == [*docs.columns, "_quality"]
    assert quality.score(nothing, quality.learn(nothing, spark.createDataFrame([], "doc_id long, label int"))).count() == 0


def test_quality_is_the_plain_sum_over_pairs():
    m = quality.Model()
    m.w = np.random.default_rng(0).normal(0, 1, len(m.w))
    columns, values = quality.features("some words of a text, some words!\nagain")
    pairs = sum(m.v[columns[i]] @ m.v[columns[j]] * values[i] * values[j] for i in range(len(columns)) for j in range(i))
    assert m.margins([(columns, values)])[0] == pytest.approx(m.bias + m.w[columns] @ values + pairs)


# ---------------------------------------------------------------- mixing


def test_mixing_by_hand(spark, docs, nothing):
    rows = [(i, "x" * n, lang, src) for i, (n, lang, src) in enumerate([(100, "en", "a"), (100, "en", "b"), (400, "en", "b"), (300, "fr", "a"), (300, "fr", None), (50, None, "c")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, F.when(F.col("source") == "c", "two").otherwise("one"), F.length("text"), F.lit(600), {"one": 1, "two": 1}, {"en": 1, "fr": 1}, epochs=1)
    took = {(r._domain, r._lang, r._source): r.t for r in out.groupBy("_domain", "_lang", "_source").agg(F.sum("_take").alias("t")).collect()}
    # Domain two has 50 of its 300; the rest goes to one: 550, by language 275 each, by source with a short one's rest.
    assert took == {("two", "?", "c"): 50, ("one", "en", "a"): 100, ("one", "en", "b"): 175, ("one", "fr", "?"): 138, ("one", "fr", "a"): 137}
    many = mixing.mix(docs, F.lit("d"), F.length("text"), F.col("tokens") * 2, {}, {}, epochs=2)
    assert many.where("doc_id in (2, 3)").count() == 0
    assert many.groupBy("_epoch").count().count() == 2
    assert mixing.mix(nothing, F.lit("d"), F.length("text"), F.col("tokens"), {}, {}).count() == 0


# ---------------------------------------------------------------- near duplicates


LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, percent=75):
    words = {i: [w.translate(LOWER) for w in re.split(r"[ \t-\r]+", t or "") if w] for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_near_dedup_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(160):
        own = base[:]
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            own[k] = f"x{i}-{k}"
        texts[i] = " ".join(own)
    for i in range(160, 200):
        texts[i] = " ".join(f"z{int(x)}" for x in rng.integers(0, 10**6, 40))
    texts |= {200: texts[3], 201: texts[170].upper(), 202: "one two", 203: "ONE  two", 204: "one", 205: "", 206: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    want = brute(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[205].n_shingles == 0 and got[202].component_id == 202 and got[203].component_id == 202


def test_near_dedup_edges(docs, nothing):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id == 1 for r in got) == 2
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dedup.near_duplicates(nothing).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**6))
def test_sketch_fills_and_estimates(n, seed):
    x = np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64)
    s = near_dedup.sketch(np.unique(x))
    assert s.max() < np.iinfo(np.uint64).max
    assert (near_dedup.sketch(np.unique(x)) == s).all()


def test_near_dedup_of_ids_with_several_texts(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, long("a")), (3, long("b")), (5, long("a")), (5, long("b")), (7, long("c")), (7, long("d")), (9, long("d")), (9, long("d")), (11, long("e"))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (3, 1), (5, 1), (7, 7), (9, 7), (11, 11)}


def test_near_dedup_deals_only_documents_that_can_meet(spark):
    # Two thousand documents share an item that stands too far back to link them; three of them can meet at it.
    hot = [(d, 100 + d % 2, d, 1, 84) for d in range(2000)] + [(5000, 100, 5000, 1, 100), (5001, 100, 5001, 1, 100), (5002, 100, 5000, 1, 99)]
    rng = np.random.default_rng(3)
    some = [(int(d), int(n), int(d) % 7, int(i), int(n - rng.integers(0, n // 4 + 1))) for d, n, i in zip(range(600), rng.integers(20, 60, 600), rng.integers(2, 40, 600))]
    rows = [(d + 10_000 * (i > 1), n, r, i, after) for d, n, r, i, after in hot + some]
    prefixes = spark.createDataFrame([(d, n, n, [(i, after)]) for d, n, _, i, after in rows], "doc_id long, n int, u int, prefix array<struct<item:long,after:int>>")
    roots = spark.createDataFrame([(d, r) for d, _, r, *_ in rows], "doc_id long, root long")
    by_item = {}
    for row in rows:
        by_item.setdefault(row[3], []).append(row)
    want = {(a[0], b[0]) for own in by_item.values() for a in own for b in own if a[0] < b[0] and a[2] != b[2] and 175 * min(a[4], b[4]) >= 75 * (a[1] + b[1])}
    assert {tuple(r) for r in near_dedup._meeting(roots, prefixes, 75).collect()} == want and {(5000, 5001), (5001, 5002)} < want
    each = spark.createDataFrame([(i, d, r, n, after) for d, n, r, i, after in rows], "item long, doc_id long, root long, n int, after int")
    assert sorted(r.doc_id for r in near_dedup._able(each, 75).where("item = 1").collect()) == [5000, 5001, 5002]


def test_near_dedup_of_templates_just_under_and_over_the_threshold(spark):
    # One template, own words from few to many: similar pairs, near misses and chains in the same buckets.
    rng = np.random.default_rng(9)
    base, texts = [f"w{i}" for i in range(200)], {}
    for i in range(150):
        n = int(rng.integers(8, 60))
        at = int(rng.integers(0, 200 - n))
        texts[i] = " ".join(base[:at] + [f"x{i % 40}-{k}" for k in range(n)] + base[at + n :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == brute(texts)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (5, 13), (20, 37)])
def test_webp_round_trips_with_every_feature(shape):
    rng = np.random.default_rng(2)
    few = rng.integers(0, 12, shape, dtype=np.uint32) * np.uint32(0x01030509) | np.uint32(0xFF000000)
    any_ = rng.integers(0, 2**32, shape, dtype=np.uint32)
    side = lambda b: tuple(-(-n // (1 << b)) for n in shape)
    modes = rng.integers(0, 14, side(2), dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    elements = rng.integers(0, 2**32, side(2), dtype=np.uint32)
    cases = [
        (few, (), {}),
        (few, ((webp.PALETTE,),), {}),
        (few & np.uint32(0xFF000003), ((webp.PALETTE,),), {"near": True}),
        (any_, ((webp.PREDICTOR, modes, 2),), {}),
        (any_, ((webp.CROSS_COLOUR, elements, 2),), {"cache_bits": 10}),
        (few, ((webp.SUBTRACT_GREEN,),), {"cache_bits": 4, "group_bits": 2}),
        (any_, ((webp.PREDICTOR, modes, 2), (webp.CROSS_COLOUR, elements, 2), (webp.SUBTRACT_GREEN,)), {"group_bits": 2, "cache_bits": 3}),
        (np.tile(few, (4, 3)), (), {"near": True}),
    ]
    files = [webp_writer.encode(p, t, **kw) for p, t, kw in cases]
    for (p, _, _), got in zip(cases, webp.decode(files)):
        assert np.array_equal(p, got)


def test_webp_known_file():
    # One opaque pixel (alpha 255, red 17, green 34, blue 51): five codes of one symbol, no bits of data.
    w = webp_writer.BitWriter()
    w.put(0, 14), w.put(0, 14), w.put(0, 1), w.put(0, 3), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for s in (34, 17, 51, 255, 0):
        w.put(0b101, 3), w.put(s, 8)
    body = bytes([0x2F]) + w.done()
    body += b"\0" * (len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode([data])[0].tolist() == [[0xFF112233]]


def _kinds(file: bytes) -> set:
    """Which transforms a written file has, and whether it has a colour cache."""
    image = webp._parsed([file])[0]
    return {k for k, *_ in image.transforms} | ({"cache"} if image.main.cache_bits else set())


def test_webp_side_by_side_writing_uses_and_inverts_every_part():
    rng = np.random.default_rng(5)
    black = np.uint32(0xFF000000)
    noise = rng.integers(0, 256, (32, 64), dtype=np.uint32)
    words = rng.integers(0, 1 << 24, 40, dtype=np.uint32)
    ramp = np.cumsum(rng.integers(0, 3, (32, 64)) * 0x010000, 1).astype(np.uint32) & np.uint32(0xFF0000)
    cases = {
        "grey noise": (noise * np.uint32(0x010101) | black, {webp.SUBTRACT_GREEN}),
        "red follows green": (noise * np.uint32(0x010100) | rng.integers(0, 9, (32, 64), dtype=np.uint32) | black, {webp.CROSS_COLOUR}),
        "blue follows red": (noise * np.uint32(0x010001) | black, {webp.CROSS_COLOUR}),
        "ramp to the right": (ramp | black, {webp.PREDICTOR}),
        "ramp downwards": (ramp[:, :32].T.repeat(2, 1)[:32, :64] | black, {webp.PREDICTOR}),
        "few colours": (words[rng.integers(0, 9, (3, 64))] | black, {webp.PALETTE}),
        "one colour": (np.full((32, 64), 0xFF202020, np.uint32), {webp.PALETTE}),
        "recurring pixels": (words[rng.integers(0, 40, (32, 64))] | black, {"cache"}),
        "noise": (rng.integers(0, 1 << 24, (32, 64), dtype=np.uint32) | black, set()),
        "one row": (words[:1].repeat(64)[None] | black, set()),
        "repeated rows": (np.tile(rng.integers(0, 1 << 24, (1, 64), dtype=np.uint32), (32, 1)) | black, set()),
    }
    files = webp.encode([p for p, _ in cases.values()])
    for (name, (p, kinds)), file, got in zip(cases.items(), files, webp.decode(files)):
        assert np.array_equal(p, got), name
        assert kinds <= _kinds(file), name
    assert len(files[-1]) < 64 * 3 + 300
    assert files == [webp.encode([p])[0] for p, _ in cases.values()]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=400), st.text("ab\n", min_size=1500, max_size=7000), st.binary(max_size=300).map(lambda b: b.decode("latin-1") * 30)), min_size=1, max_size=6))
def test_media_round_trips_any_text(texts):
    raw = [media.payload(t) for t in texts]
    assert [a.tobytes() for a in media.read(media.write(raw))] == raw


def test_media(docs, nothing):
    got = media.digest(media.store(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = media.payload(r.text)
        assert (r._payload_bytes, r._payload_sha256, r._tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert len({(r._media_sha256, r._feature) for r in got if r.doc_id in (1,)}) == 1
    assert [bytes(r._payload) for r in media.load(media.store(docs.where("doc_id = 2"))).collect()] == [b" " * 192]
    assert media.digest(media.store(nothing)).count() == 0


# ---------------------------------------------------------------- search


def test_topk(spark, nothing):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 8).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, [0.5, 0.5]), (550, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 50 = 0"), 5).collect()]
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    empty = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert topk.search(empty, empty, 5).count() == 0
    assert topk.search(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2


def test_topk_without_queries_and_with_a_repeated_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(1, 40)], "vec_id long, vector array<double>")
    assert topk.search(df, df.where("vec_id % 50 = 0"), 5).collect() == []
    assert topk.search(df, spark.createDataFrame([(0, None), (50, [1.0, None])], df.schema), 5).collect() == []
    monkeypatch.setattr(topk, "QUERIES", 8)
    sizes = []
    kept = topk.cut
    monkeypatch.setattr(topk, "cut", lambda frame, label: (out := kept(frame, label), sizes.extend(r.n for r in out.collect()) if label == "questions" else None)[0])
    one = df.where("vec_id = 7")
    want = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, one, 3).collect()]
    assert [r[1] for r in sorted(want)] == [1, 2, 3]
    sizes.clear()
    asked = one.union(df.where("vec_id = 9")).crossJoin(spark.range(30)).drop("id")
    got = topk.search(df, asked, 90)
    # Each copy of a query finds all others; the best 90 of its id are three rows' thirty copies.
    best = [(r.vec_id, r.score) for r in got.where("query_id = 7").collect()]
    assert sorted(set(best), key=lambda x: (-x[1], x[0])) == [w[2:] for w in sorted(want)] and len(best) == 90
    assert sum(sizes) == 60 and max(sizes) <= 8


# ---------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m[0]))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)


TRICKY = [
    "a@b.c_d@e.f x@y@z.com é😀 +1 (234) 555-1234 1.2.3.4.5 999.1.1.1 0001.2.3.4 4111 1111 1111 1111",
    "4111-1111-1111-1111 4111111111111112 +12 +1 2 3 4 5 6 7 8 9 me@host me@host. a.b@c-d.e1 @x.y",
    "1" * 30_000 + " " + "1 " * 20_000 + "+" + " " * 3000 + "+1" + " " * 3000 + "2345678901",
    "", None, "no data here", "256.1.1.1 1.2.3.00255 +1.2.3.4.5.6.7.8.9",
]


def test_pii_base_spans(spark, docs, nothing):
    rng = np.random.default_rng(1)
    pool = list("019@.+- ()a_😀é") + ["4111 1111 1111 1111", "a@b.cc", "1.2.3.4", "+1 (234) 555-0000"]
    texts = TRICKY + ["".join(rng.choice(pool, 60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.find(df).select("doc_id", "text", pii.written("_base").alias("base"), pii.written("_spans").alias("all")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.base == plain_spans(r.text), r.text[:200]
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r["all"].split(",")))
    assert pii.find(docs).count() == len(ROWS) and pii.find(docs).columns[: len(docs.columns)] != []
    assert pii.find(nothing).count() == 0
    t = spark.createDataFrame([(1, "mail a@b.cc or +1 (234) 555-0000!"), (2, None)], "doc_id long, text string")
    assert [r.t for r in pii.find(t).select(pii.redacted().alias("t")).collect()] == ["mail [email] or [phone]!", ""]


def test_pii_trees_add_what_looks_alike(spark):
    rows = [(i, f"call +1 (2{i % 10}4) 555-{1000 + i} now") for i in range(400)] + [(1000 + i, f"on 2024-01-{10 + i % 20} we met") for i in range(200)]
    # Without a country code: no base span, but of the same body.
    rows += [(2000 + i, f"call (2{i % 10}4) 555-{1000 + i} now") for i in range(5)]
    rows += [(3000 + i, f"password=a1b2c3d4e5f60718{i}") for i in range(200)] + [(4000, "a1b2c3d4e5f60718293 lies about")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written("_spans").alias("s"), pii.written("_base").alias("b")).collect()}
    assert all(got[i].s == got[i].b == "phone:5:22" for i in range(400)) and all(got[1000 + i].s == "" for i in range(200))
    assert all((got[2000 + i].b, got[2000 + i].s) == ("", "phone:5:19") for i in range(5))
    assert all(got[3000 + i].s.startswith("secret:9:") for i in range(200)) and got[4000].b == ""
    # What looks like the assigned ones is found where it stands alone.
    assert got[4000].s == "secret:0:19"
    rest = len(pii.FEATURES) - 1
    features = np.array([[1] + [0] * rest, [9] + [0] * rest])
    trees = pii.Trees(features, np.array([50.0, 50.0]), np.array([0.0, 49.0]))
    assert trees.probabilities(features)[1] > 0.9 > 0.1 > trees.probabilities(features)[0]
    assert pii.calibrated(np.array([0.9, 0.6]), np.array([50.0, 50.0]), np.array([50.0, 10.0]), 0.98) == 0.9


def test_pii_secrets_are_found_by_their_format(spark):
    rng = np.random.default_rng(3)
    token = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, f'set token = "{token(40)}" here') for i in range(300)]
    alone = [(1000 + i, f"see {token(40)} there") for i in range(20)] + [(1100 + i, f"key ghp_{token(36)} there") for i in range(3)]
    plain = [(2000 + i, f"order ORDER-2024-000{i:09d} of page/item-{i:012d}/more and {i:020d}") for i in range(300)]
    df = spark.createDataFrame(rows + alone + plain, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.written("_spans").alias("s")).collect()}
    # A base span inside a token stays, and nothing is added over it.
    assert all(got[i] == "secret:13:53" or "card:" in got[i] for i, _ in rows) and sum("secret" in got[i] for i, _ in rows) > 290
    assert all(got[1000 + i] == "secret:4:44" for i in range(20))
    assert not any("secret" in got[i] for i, _ in plain)
    # The trees of secrets see no context.
    trees = pii.Trees(np.zeros((2, len(pii.FEATURES))) + [[0], [5]], np.array([50.0, 50.0]), np.array([0.0, 49.0]), pii.SEES["secret"])
    assert all(tree[0] < len(pii.FORMATS) for tree in trees.trees)


def test_pii_descriptions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(pii, "DESCRIPTIONS", 4)
    rows = [(i, f"call +1 (2{i % 10}4) 555-{1000 + i} now, {'x' * (i % 30)}{i} a{i}@b{i % 7}.example") for i in range(200)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 200 and out.where("size(_spans) < size(_base)").count() == 0


def test_pii_results_do_not_depend_on_how_many_descriptions_there_are(spark, monkeypatch):
    # Keys in two of three documents, and far more descriptions than a task takes at a time.
    rows = [(i, f"call +1 (2{i % 10}4) 555-{1000 + i} now, {'x' * (i % 30)}{i} a{i}@b{i % 7}.example " + (f"api_key = Zq{i:03d}kX81vbRt72LmPw{i:03d}" if i % 3 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda: {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.written("_spans").alias("s")).collect()}
    want = spans()
    assert sum("secret" in s for s in want.values()) > 50
    monkeypatch.setattr(pii, "DESCRIPTIONS", 4)
    assert spans() == want


def test_pii_trees_grow_by_aggregations_alone(spark, monkeypatch):
    rng, names = np.random.default_rng(5), [f"y{i}" for i in range(len(pii.NAMES))]
    features, n = rng.integers(0, 6, (300, len(pii.FEATURES))), rng.integers(1, 9, 300)
    y = np.minimum(n[:, None], (features[:, : len(names)] + features[:, 3:4] > 6) * n[:, None])
    # One kind without a positive grows no tree.
    y[:, 1] = 0
    table = spark.createDataFrame([tuple(map(int, r)) for r in np.c_[features, n, y]], ", ".join([*(f"{f} int" for f in pii.FEATURES), "n long", *(f"{c} long" for c in names)]))
    opened = lambda: [pii.Trees.open(float(y[:, i].sum()), float(n.sum()), pii.SEES.get(name, pii.FEATURES)) for i, name in enumerate(pii.NAMES)]
    want, got = opened(), opened()
    pii.boost(want, lambda splits: pii._folded(list(pii._histograms(want, splits, features, n.astype(float), y.astype(float)))), rounds=3)

    def python(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(table), "mapInArrow", python)
    pii.boost(got, pii._summed(table.repartition(3), got), rounds=3)
    assert [len(m.trees) for m in want] == [3, 0, 3, 3, 3]
    for a, b in zip(want, got):
        assert [t[:2] for t in a.trees] == [t[:2] for t in b.trees]
        assert np.allclose(a.probabilities(features), b.probabilities(features), atol=1e-5)
    # What a candidate's score is computed by in Spark is what the trees say.
    scored = table.alias("x").selectExpr(f"{got[0].sql()} as p").toPandas().p
    assert np.allclose(np.sort(scored), np.sort(got[0].probabilities(features)), atol=1e-12)


def test_pii_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.cc 10.0.{i % 300}.1" for i in range(20_000))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.written("_base").alias("b"), *[pii.counted("_base", k).alias(k) for k in pii.KINDS]).first()
    assert row.b == plain_spans(text) and row.email == 20_000 and row.ip == sum(i % 300 <= 255 for i in range(20_000)) and row.phone == 0


# ---------------------------------------------------------------- pages


def test_html(spark):
    long = "A sentence of the story that goes on for a good while, with many words in it. "
    cases = {
        None: "",
        "": "",
        "<nav><a href=x>Menu</a></nav><article><h1>Head &amp; tail</h1><p>One\n  two<br>three<p>four</article><footer>f</footer>": "Head & tail One two three four",
        "<article><p>a</p><div class='comments'><p>nice</p></div><aside>side</aside><script>x('</p>')</script><form>f</form><p>b": "a b",
        f"<div class=menu><a>x</a><a>y</a></div><div><h2>T</h2><p>{long}</p><p>{long}</p></div><ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul><div class='cookie-notice'>We use cookies {long}</div>": f"T {long.strip()} {long.strip()}",
        "<p>only a little</p>": "only a little",
    }
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r._text for r in html_text.extract(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert html_text.extract(df.limit(0)).count() == 0


def plain_article(page: str) -> str:
    """What lies between the article's tags, cut at block tags."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h[1-6]|br|li|ul|ol|div|blockquote|pre|table|tr|td|th)\b[^>]*>", inside)
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", q)).split()) for q in parts) if x)


def test_html_text_comes_from_the_regions():
    long = "There is a way home over the hill, and another one by the sea. " * 4
    body = f"<h1>Head</h1><p>{long}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{long}</p><p>End.</p>"
    want = " ".join(f"Head {long} Short. one two {long} End.".split())
    # The same with any element or none around the blocks: what marks call an article adds nothing.
    for around in ("div", "article", "section", "main", "td"):
        page = f"<body><div class=nav><a href=x>Menu</a></div><div><p>Teaser</p></div><{around}>{body}</{around}><div><p>More</p><a href=y>Next</a></div></body>"
        assert " ".join(html_text.main_text(page).split()) == want, around
    assert " ".join(html_text.main_text(f"<body><article><p>Teaser</p></article><div>{body}</div></body>").split()) == want


def test_html_odd_pages(spark):
    long = "Words of a long page. " * 50_000
    rows = [(1, "u", f"<article><p>{long}</p></article>", "x"), (2, None, "<p>same</p>", "y"), (2, None, "<p>same</p>", "y"), (None, None, None, None), (3, "v", "<div>" * 5000 + "deep", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _text string")
    got = html_text.extract(df)
    assert sorted(got.columns) == sorted(df.columns) and sorted((len(r._text) for r in got.collect())) == [0, 4, 4, 4, len(long.strip())]


def test_html_of_all_pages_with_and_without_the_mark(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = found = wanted = 0
    for page in pages:
        want = plain_article(page)
        assert html_text.main_text(page) == want
        # The regions find the same without the mark.
        assert html_text.main_text(page.replace("<article", "<div").replace("</article", "</div")) == want
        # Without any element around the blocks: no word that isn't the article's, and nearly every one that is.
        got = Counter(html_text.main_text(re.sub("</?article[^>]*>", "", page)).split())
        right, found, wanted = right + sum((got & Counter(want.split())).values()), found + got.total(), wanted + len(want.split())
    assert right >= 0.995 * found and right >= 0.995 * wanted


def test_html_regions_overrule_a_mark_that_holds_little():
    long = "A sentence of the story that goes on for a good while, with many words in it."
    body = f"<div><h1>Head</h1><p>{long}</p><p>{long}</p><p>{long}</p></div>"
    assert html_text.main_text(f"<article><a href=x>Teaser</a></article>{body}").endswith(f"Head {long} {long} {long}")
    assert html_text.main_text(f"<div><p>Hi</p></div><article>{body}</article>") == f"Head {long} {long} {long}"


def test_html_articles_in_wrappers():
    long = "A sentence of the story that goes on for a good while, with many words in it."
    story = f"<article><h1>Head</h1><p>{long}</p></article>"
    for outer in ("div class='has-sidebar'", "div class='layout--with-sidebar'", "section class='nav-open'", "div id=page class='share-enabled'", "form id=aspnetForm", "div class='sidebar'", "div class='widget'"):
        tag = outer.split()[0]
        for inner in (story, story.replace("article", "main"), f"<div class=content><h1>Head</h1><p>{long}</p></div>"):
            aside = "<nav>Menu</nav><div class='comments'><article>Nice story</article></div><div class=ad>Buy</div>"
            assert html_text.main_text(f"<body><{outer}>{inner}{aside}</{tag}><footer>f</footer>") == f"Head {long}"
        # No mark at all: most of the page's text is in the wrapper.
        assert html_text.main_text(f"<p>x</p><{outer}><p>{long}</p><p>{long}</p></{tag}>").endswith(f"{long} {long}")
    # What isn't the page's article stays out, even if it is longer.
    for other in (f"<div class=comments>{story * 3}</div>", f"<div class=related>{story * 9}</div>", f"<div class=sidebar>{story}</div>", f"<form>{long}</form>"):
        assert html_text.main_text(f"<article><p>The first. {long}</p></article>{other}") == f"The first. {long}"
    assert html_text.main_text(f"<div class=comments><p>{long}</p></div>") == long
    assert html_text.main_text("<nav>Menu</nav>") == ""


def test_html_reads_on_past_unknown_sections():
    for odd in ("<![foo[x]]>", "<![endo x]>", "<![ x]>", "<![[>", "<![CDATA[x]]>", "<!x>"):
        assert html_text.main_text(f"<article><p>one</p>{odd}<p>two</p></article>") == "one two", odd


def test_fold(spark):
    got = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got) and Counter(r.f for r in got)[0] > 0
