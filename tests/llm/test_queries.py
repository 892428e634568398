"""The corpus queries over the smallest tables, and the pipeline against its stages one by one."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tallyforge.llm import quality, queries
from tallyforge.llm.common import table
from tests.llm.test_small import LOWER, brute


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, sf, duck):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_all_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_held_out_accuracy(spark, sf):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    lang = queries.op2_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    good = queries.op6_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    assert (good.predicted == good.quality).mean() > 0.9


def test_pii_query_against_plain_spans(spark):
    from tests.llm.test_small import plain_spans

    whole = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, whole, "documents").select("doc_id", "text").collect()}
    rows = queries.op8_pii(spark, whole).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        base = [s for s in plain_spans(texts[r.doc_id]).split(",") if s]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r.spans.split(",")) and r.n_spans == len([s for s in r.spans.split(",") if s])


def test_near_dedup_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {r.doc_id: r.component_id for r in queries.op9_near_dedup(spark, sf).collect()} == brute(docs)


def test_dedup_stage_keeps_one_row_of_repeated_rows(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, long("a"), "s"), (1, long("a"), "s"), (2, long("a"), "s"), (3, long("b"), "s"), (3, long("c"), "s"), (4, long("d"), "s")]
    rows += [(None, long("e"), "s"), (None, long("e"), "s"), (None, long("f"), "s"), (None, None, "s"), (None, "", "s"), (5, None, "s"), (5, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.key` string").repartition(4)
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    texts = {i: sorted(t for d, t in got if d == i) for i in (1, 4)}
    assert texts == {1: [long("a")], 4: [long("d")]}
    assert [d for d, _ in got].count(3) == [d for d, _ in got].count(5) == 1 and (5, None) in got and 2 not in [d for d, _ in got]
    assert sorted((t for d, t in got if d is None), key=str) == sorted([long("e"), long("f"), None, ""], key=str)


def plain_good(model, text: str) -> bool:
    """The factorisation machine with every pair of columns multiplied out."""
    columns, values = quality.features(text)
    pairs = model.v[columns] @ model.v[columns].T * np.outer(values, values)
    margin = model.bias + (model.w[columns] * values).sum() + np.triu(pairs, 1).sum()
    return 1 / (1 + np.exp(-margin)) >= quality.ACCEPT


def plain_lines(docs: dict[int, str]) -> dict[int, str]:
    """Texts without the lines that ten documents share."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    shared = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")})
    return {i: "\n".join(x for x in t.split("\n") if not key(x) or shared[key(x)] < 10) for i, t in docs.items()}


def test_pipeline_against_plain_stages(spark, sf, duck):
    rows = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    model = queries.quality_model(spark, sf)
    texts = plain_lines({i: r.text for i, r in rows.items() if plain_good(model, r.text)})
    assert 0 < len(texts) < len(rows)
    root = brute(texts)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    assert len(texts) < len(rows)
    # The SQL of the mixing query over what is left, for one epoch.
    left = pd.DataFrame([(i, t, rows[i].lang, rows[i].source) for i, t in texts.items()], columns=["doc_id", "text", "lang", "source"])
    con = duckdb.connect()
    con.register("documents", left)
    once = queries.OP3_SQL.replace("sum(tokens) * 2", "sum(tokens)").replace("unnest([1, 2])", "unnest([1])")
    chosen = {i: texts[i] for i in con.sql(once).df()["doc_id"].tolist()}
    assert 0 < len(chosen) < len(texts)
    hold_packed(corpus_pipeline.run(spark, sf).collect(), chosen)


def hold_packed(pieces, texts: dict[int, str]) -> None:
    """Every token of every text in exactly one piece, pieces of a window side by side from 0, little padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    of, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    assert set(of) == set(ids)
    for i, own in of.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    room = 0
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        room += at if at & (at - 1) == 0 else 4096
    assert sum(map(len, ids.values())) > 0.97 * room


def test_packing_query_holds_every_token(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    hold_packed(queries.op1_packing(spark, sf).collect(), texts)


def test_media_query_against_the_payload(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = queries.op5_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        whole = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def odd_documents(spark, sf):
    """Nulls, empty and long texts, repeated rows, a missing id, and columns named as those that stages make."""
    long = "Ann went home over the hill and saw the sea. " * 5
    rows = [(1, long, "en", "src0", 9, "x"), (1, long, "en", "src0", 9, "x"), (2, None, None, None, None, None), (3, "", "en", "src1", 0, ""), (None, long + "more", "fr", "src9", 1, "y"), (4, "word " * 30_000, "de", None, 5, "z")]
    # A line that ten documents share, one of them twice, and by white space and case one more.
    rows += [(10 + i, f"own {i}\n Shared LINE\t\nshared line\nkept {i}", None, "src2", None, "_key") for i in range(10)] + [(30, "nine\nonly nine", "es", "src1", 3, "k")]
    rows += [(40 + i, f"only nine\nbut {i}", "es", "src1", 3, "k") for i in range(8)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(3)


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_stages_of_an_empty_table(spark, sf):
    none = odd_documents(spark, sf)[1].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == "packing" or sorted(out.columns) == sorted(none.columns))


def test_quality_stage_of_odd_rows(spark, sf):
    rows, docs = odd_documents(spark, sf)
    model = queries.quality_model(spark, sf)
    got = bag(corpus_pipeline.classify(spark, docs, sf))
    assert got == Counter(r for r in rows if plain_good(model, r[1] or "")) and len(got) < len(set(rows))


def test_line_stage_of_odd_rows(spark, sf):
    rows, docs = odd_documents(spark, sf)
    want = Counter()
    for i, text, lang, source, n, row in rows:
        kept = "\n".join(x for x in (text or "").split("\n") if x.strip().lower() != "shared line")
        want[i, kept, lang, source, len(kept), row] += 1
    out = corpus_pipeline.clean_lines(spark, docs, sf)
    assert bag(out.select(*docs.columns)) == want and sorted(out.columns) == sorted(docs.columns)


def test_near_dedup_stage_of_odd_rows(spark, sf):
    rows, docs = odd_documents(spark, sf)
    # The long text is one document, its copy without an id is in no group; nothing else is alike.
    want = Counter({r: 1 for r in rows})
    root = brute({r[0]: r[1] or "" for r in rows if r[0] is not None})
    want = Counter({r: 1 for r in want if r[0] is None or root[r[0]] == r[0]})
    assert bag(corpus_pipeline.one_of_each(spark, docs, sf)) == want


def test_mixing_stage_of_odd_rows(spark, sf):
    rows, docs = odd_documents(spark, sf)
    got = bag(corpus_pipeline.mix(spark, docs, sf))
    tokens = lambda r: (len(r[1] or "") + 3) // 4
    every = Counter(rows)
    total = sum(tokens(r) * n for r, n in every.items())
    assert not got - every and all(r[1] for r in got)
    # Whole documents up to three quarters of the tokens: no leaf's last one reaches beyond by more than itself.
    leaf = lambda r: (r[2], r[3])
    last = sum(max(tokens(r) for r in got if leaf(r) == own) for own in {leaf(r) for r in got})
    taken = sum(tokens(r) * n for r, n in got.items())
    assert total * 3 // 4 <= taken <= total * 3 // 4 + last
    # Nothing is scarce but room: the same rows in any order of partitions.
    assert got == bag(corpus_pipeline.mix(spark, docs.repartition(7), sf))


def test_packing_stage_of_odd_rows(spark, sf):
    rows, docs = odd_documents(spark, sf)
    texts = {r[0]: r[1] for r in rows if r[0] not in (1, None)}
    out = corpus_pipeline.pack(spark, docs, sf).collect()
    single = [p for p in out if p.doc_id not in (1, None)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted((p for p in single if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    # A repeated row is laid twice, one without an id once.
    twice = len(tokenizer.encode(rows[0][1], add_special_tokens=False).ids) + 1
    once = len(tokenizer.encode(rows[4][1], add_special_tokens=False).ids) + 1
    assert sum(p.length for p in out if p.doc_id == 1) == 2 * twice and sum(p.length for p in out if p.doc_id is None) == once
