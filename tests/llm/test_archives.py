"""WARC archives and their index, token alignment and the audit of filters, against plain versions and on odd tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from tallyforge.llm import alignment, audit, queries, warc
from tallyforge.llm.common import table

# ---------------------------------------------------------------- archives


def test_keys_of_urls():
    want = {
        "http://www.Example.com/a?b=c#top": "com,example)/a?b=c",
        "https://m.example.com": "com,example,m)/",
        "https://u:p@example.com:8443/x": "com,example:8443)/x",
        "http://example.com:80/": "com,example)/",
        "http://10.0.0.1/x y": "10.0.0.1)/x%20y",
        "no url at all": "no%20url%20at%20all",
        "http://[::1": "http://[::1",
        None: "",
    }
    assert {u: warc.surt(u) for u in want} == want


def test_records_say_what_they_hold():
    sha = hashlib.sha1(b"\r\n\r\nbody").hexdigest()
    whole = warc.capture(7, "http://a.example/\n", b"\r\n\r\nbody", sha, "2024-01-01T00:00:00Z")
    headers, payload, size = warc.parse(whole)
    assert (headers["warc-type"], headers["warc-target-uri"], payload, size) == ("response", "http://a.example/%0A", b"\r\n\r\nbody", 8)
    headers, payload, size = warc.parse(warc.capture(8, None, b"\r\n\r\nbody", sha, "2024-01-01T00:00:00Z", 7, "http://a.example/"))
    assert (headers["warc-type"], headers["warc-refers-to"], payload, size, "warc-target-uri" in headers) == ("revisit", "<urn:page:7>", None, 8, False)
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(bad.compress(zlib.decompress(whole, 31).replace(b"body", b"bodx")) + bad.flush())


ODD = "page_id long, url string, html string, _refers string, digest int"


def odd_pages(spark):
    copy = "<p>" + "é" * 600
    rows = [(1, "http://a.example/x", copy), (2, "http://a.example/x", copy), (2, "http://a.example/x", copy), (None, "http://a.example/x", copy), (3, None, None), (4, "", ""), (5, "http://b.example/\n", "s"), (6, "http://b.example/", "s")]
    rows += [(7, "http://long.example/", "x" * 3_000_000), (None, None, "y" * 2000), (None, "http://n.example", "y" * 2000)]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], ODD), rows


def wanted(rows):
    top = {}
    for page, _, html in rows:
        top[html or ""] = max((x for x in (page, top.get(html or "")) if x is not None), default=None)
    out = []
    for page, _, html in rows:
        body, keep = (html or "").encode(), top[html or ""]
        again = len(body) >= 1000 and keep is not None and page != keep
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keep if again else None))
    return Counter(out)


@pytest.mark.parametrize("few", [False, True])
def test_every_page_is_read_back(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    pages, rows = odd_pages(spark)
    more = [(100 + i, f"http://h{i % 7}.example/{i % 40}", f"page {i % 9} " * 200) for i in range(400)]
    pages = pages.union(spark.createDataFrame([(*r, "clash", 0) for r in more], ODD))
    archive = warc.write(pages, file_bytes=5000, block_lines=10, range_lines=50)
    assert len(archive.ranges) > 1 and all(a[1] <= b[0] for a, b in zip(archive.ranges, archive.ranges[1:]))
    got = archive.fetch(archive.lookup(pages.select("url"))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted(rows + more)
    # A lookup gives all captures of a key, and the payload if asked.
    one = archive.fetch(archive.lookup(spark.createDataFrame([("https://a.example/x#f",), ("http://none.example/",)], "url string")), payload=True).collect()
    assert Counter((r.page_id, r.payload is None) for r in one) == Counter({(1, True): 1, (2, False): 2, (None, True): 1})
    # One URL of most captures lies in several ranges.
    hot = warc.write(pages.withColumn("url", F.lit("http://hot.example/")), block_lines=10, range_lines=50)
    assert hot.fetch(hot.lookup(pages.limit(1).select(F.lit("http://hot.example/").alias("url")))).count() == len(rows + more)


def test_archives_are_plain_gzip_members(spark):
    pages, rows = odd_pages(spark)
    archive = warc.write(pages)
    store, path = FileSystem.from_uri(archive.folder) if "://" in archive.folder else (FileSystem.from_uri(f"file://{archive.folder}")[0], archive.folder)
    from pyarrow.fs import FileSelector

    kinds = Counter()
    for f in store.get_file_info(FileSelector(path)):
        if f.path.endswith(".warc.gz"):
            raw = store.open_input_file(f.path).readall()
            while raw:
                z = zlib.decompressobj(31)
                text = z.decompress(raw)
                assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
                kinds[text.split(b"\r\n")[1].split()[1].decode()] += 1
                raw = z.unused_data
    assert kinds["response"] + kinds["revisit"] == len(rows) and kinds["revisit"] == 2 and kinds["warcinfo"] >= 1


def test_no_pages(spark):
    archive = warc.write(spark.createDataFrame([], ODD))
    assert archive.fetch(archive.lookup(spark.createDataFrame([("http://a.example/",)], "url string"))).count() == 0


# ---------------------------------------------------------------- alignment

PATHS = None


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_alignment(texts, paths):
    """Byte by byte, token pair by token pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in kept]
    letters = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(rest)}
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for text in texts:
        sides, spans = [[], []], [[], []]
        if text:
            sides = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            raw = (" " + text).encode()
            if any(b"".join(map(of, ids)) != raw for of, ids in zip((of_a, of_b), sides)):
                sides = [[], []]
        for side, of in ((0, of_a), (1, of_b)):
            at = 0
            for i in sides[side]:
                spans[side].append((at, at + len(of(i))))
                at += len(of(i))
        links = [(i, j) for i, (s, e) in zip(sides[0], spans[0]) for j, (t, f) in zip(sides[1], spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, (s, e) in zip(sides[k], spans[k]) if lo < e <= hi) for k in (0, 1)) for lo, hi in zip([0, *cuts], cuts)]
        counts.update(links)
        rows.append((len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


TEXTS = ["the cat sat", None, "", " ", "  two  spaces ", "tab\tand\nline \n\n end", "<s> </s> <unk> <|endoftext|>", "U+2581 ▁ inside", "ﬁ é é 日本語 😀👩‍👩‍👧", "a\0b", "the cat sat", "x" * 50, "it's don't we'll 1234567 $#%", " nbsp　wide", "<0x41> <0x0A>", "  line", "ab " * 300 + "\t " * 40 + "end  "]


@pytest.mark.parametrize("piece, common", [(1 << 18, 200_000), (16, 5)])
def test_alignment_against_plain(spark, paths, piece, common):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["the", "Thermo", "naïve", "überall", "x1", "日本", "\n", "", "don't"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i if i % 5 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pair string").repartition(3)
    got = alignment.align(docs, *paths, common_pairs=common, piece=piece).collect()
    want = plain_alignment(texts, paths)
    assert Counter(tuple(r) for r in got) == Counter((i if i % 5 else None, *w) for i, w in enumerate([(*w[:6], w[6]) for w in want]))


def test_pieces_lay_the_text_out():
    for text in TEXTS[3:]:
        parts = list(alignment.pieces(text, True, 8))
        assert "".join(parts) == " " + text and all(p.startswith(" ") for p in parts)
    assert list(alignment.pieces("a b c d", False, 1)) == [" a b c d"]


def test_alignment_query_on_all_documents(spark, sf, paths):
    docs = table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, sf).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, plain_alignment_fast([d.text for d in docs], paths))}


def plain_alignment_fast(texts, paths):
    """As plain_alignment, with the tokens of each byte in place of all pairs of a text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    rows, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        size = lambda i: 1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode())
        whole = " " + (text or "")
        if not text or "".join(b.id_to_piece(i).replace("▁", " ") if not b.is_byte(i) else "" for i in ids_b) != whole and b.decode(ids_b) != text or "▁" in whole:
            rows.append((0, 0, 0, [], ""))
            continue
        # The token of each byte, by each side; bytes of the first from its byte-level pieces, one letter a byte.
        own_a = [i for i, t in enumerate(ids_a.tokens) for _ in t]
        own_b = [j for j, t in enumerate(ids_b) for _ in range(size(t))]
        assert len(own_a) == len(own_b) == len(whole.encode())
        pairs = sorted(set(zip(own_a, own_b)))
        groups, side_a, side_b = [], [], []
        for k, (i, j) in enumerate(zip(own_a, own_b)):
            if i not in side_a[-1:]:
                side_a.append(i)
            if j not in side_b[-1:]:
                side_b.append(j)
            if k + 1 == len(own_a) or own_a[k + 1] != i and own_b[k + 1] != j:
                groups.append(",".join(str(ids_a.ids[x]) for x in side_a) + "|" + ",".join(str(ids_b[x]) for x in side_b))
                side_a, side_b = [], []
        links = [(ids_a.ids[i], ids_b[j]) for i, j in pairs]
        counts.update(links)
        rows.append((len(ids_a.ids), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def test_alignment_of_nothing(spark, paths):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0
    none = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *paths).collect()
    assert sorted(tuple(r) for r in none) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


# ---------------------------------------------------------------- audit


def figures(text):
    raw = (text or "").encode()
    words = raw.split()
    return [len(words), len(set(words)), sum(65 <= b <= 90 for b in raw), sum(b in b"#$%&*|" for b in raw), len(text or "")]


@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_figures_of_buffers(size):
    rng = random.Random(1)
    texts = ["", "a", " a ", "a\x0bb\x0cc\x1cd\x85e f", "Aa Aa aA", "#x $y", "é É 😀 \n\t\r", None, "w" * 300, "a b " * 100, "x" * 63 + " y"]
    texts += ["".join(rng.choice("ab AB\n\t#é") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    column = pa.array([(t or "").encode() for t in texts], pa.binary())
    got = audit.Scanner(size).scan(column)
    assert list(map(list, zip(*(x.tolist() for x in got)))) == [figures(t) for t in texts]
    cut = audit.Scanner(size).scan(column.slice(3, 20))
    assert list(map(list, zip(*(x.tolist() for x in cut)))) == [figures(t) for t in texts[3:23]]


def test_words_that_share_a_hash_are_told_apart():
    scanner = audit.Scanner()
    scanner.numbers = np.zeros(256, np.uint64)
    texts = [b"a b a cc dd a", b"x", b"", b"q q q"]
    words, distinct, _, _ = scanner.distinct(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert words.tolist() == [6, 1, 0, 3] and distinct.tolist() == [4, 1, 0, 1]
    scanner.size = 4
    assert scanner.long(np.frombuffer(b"a b a cc dd a b", np.uint8))[:2] == [7, 4]


def plain_audit(docs, labels):
    smallest, marks = {}, {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, good, toxic in labels:
        if i is not None:
            g, t = marks.get(i, (False, False))
            marks[i] = (g or good == 1, t or toxic == 1)
    fails = []
    for i, text, lang in docs:
        n, distinct, caps, symbols, chars = figures(text)
        bad = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * caps > 3 * chars, "D": symbols > 0, "E": i is not None and i > smallest[text or ""]}
        fails.append((lang or "", {f for f in bad if bad[f]}, *marks.get(i, (False, False))))
    out = {}
    for part in {x[0] for x in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                only = sum(x[1] == {f} for x in fails if x[0] == part)
                out[part, "".join(order), step] = [len(left), len(hit), redundant, only, sum(x[2] for x in hit), sum(x[3] for x in hit)]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_audit_against_plain(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcD") for _ in range(rng.randint(1, 4)))
    texts = [None, "", "Copy of a text #1"] + [" ".join(word() for _ in range(rng.choice([5, 250, 260]))) + rng.choice(["", " |"]) for _ in range(30)] + ["long " * 300_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(200)]
    docs += docs[:5] + [(i, "Copy of a text #1", "en") for i in range(100, 180)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    d = spark.createDataFrame([(*x, "m", 1) for x in docs], "doc_id long, text string, lang string, mask string, words int").repartition(4)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got} == plain_audit(docs, labels) and len(got) == 3 * 600


def test_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "a a", "x"), (2, "b", "x")], "doc_id long, text string, lang string"), labels, {"few": "words < 2"}).collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in one] == [("few", 1, 1, 1, 1)]
