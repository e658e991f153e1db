"""Each registered query, through the entry point and over its whole table, against the library it stands for or a brute-force version."""

import base64
import re
from collections import Counter
from hashlib import sha256
from math import log
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__
from strata.llm import html_text, language_id
from test_operators import brute_fingerprint, brute_identify, brute_repeats, lower

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def run(spark, data):
    return lambda name: __spark_entry__.queries()[name](spark, data).collect()


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_op1(run, spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = run("op1_html_text")
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == html_text.main_text(pages[r.page_id].html or "")
        assert "<script" not in r.text and "</p>" not in r.text and not re.search(r"[ \t]\n|\n\n|  |^\s|\s$", r.text)
    assert sum(bool(r.text) for r in rows) > 0.95 * len(rows)


def test_op2(run, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run("op2_byte_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256((docs[r.doc_id].text or "").encode()).hexdigest()


def test_op3(run, spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    found = {}
    for r in sorted(run("op3_hilbert_ann"), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    right = 0
    for q, own in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        right += len({v for _, v in own} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert own == sorted(own) and all(s == pytest.approx(d[ids == v][0], abs=1e-12) for s, v in own)
    assert right >= 0.9 * 10 * len(found)


def test_op4(run, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in run("op4_token_files")}
    assert set(rows) == set(docs)
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)


def test_op5(run, docs):
    words = {i: WORD.findall(lower(r.text)) for i, r in docs.items()}
    grams = lambda w, k: zip(*(w[j:] for j in range(k)), strict=False)
    total = Counter(g for w in words.values() for k in (1, 2, 3) for g in grams(w, k))
    n = sum(map(len, words.values()))
    rows = {r.doc_id: r for r in run("op5_ngram_lm")}
    assert set(rows) == set(docs)
    for i, w in words.items():
        own = Counter(g for k in (1, 2, 3) for g in grams(w, k))
        score = 0.0
        for at in range(len(w)):
            for k in range(min(3, at + 1), 0, -1):
                g = tuple(w[at - k + 1 : at + 1])
                outside = total[g] - own[g]
                if k == 1:
                    score += log(max(outside, 0.5) / max(1, n - len(w))) + (3 - k) * log(0.4)
                elif outside > 0:
                    score += log(outside / (total[g[:-1]] - own[g[:-1]])) + (3 - k) * log(0.4)
                    break
        assert rows[i].n_words == len(w) and rows[i].log_prob == pytest.approx(score, rel=1e-9, abs=1e-6)


def test_op6(spark, data):
    data = data.replace("sf0.001", "sf0.1")  # the smaller ones have too few labels to learn from
    rows = {r.doc_id: r for r in __spark_entry__.queries()["op6_toxicity"](spark, data).collect()}
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_op7(run, docs, spark, data):
    windows = {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(r.item_id))
    rows = {r.doc_id: r for r in run("op7_decontaminate")}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        w, hit, items = WORD.findall(lower(docs[i].text)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= own
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), len(items) >= 2)
        assert r.items_sha256 == sha256(",".join(sorted(items)).encode()).hexdigest()


def test_op8(run, docs):
    fps = {i: brute_fingerprint(r.text) for i, r in docs.items()}
    label, changed = {i: i for i in docs}, True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    rows = {r.doc_id: r for r in run("op8_simhash")}
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{fps[i]:016x}", label[i]) for i in docs}


def test_op9(run, docs):
    hit, cut = brute_repeats([(i, docs[i].text) for i in sorted(docs)], 50)
    covered = lambda spans: {k for s in spans.split(",") if s for k in range(*map(int, s.split("-")))}
    rows = {r.doc_id: r for r in run("op9_suffix_dedup")}
    assert set(rows) == set(hit)
    for i, r in rows.items():
        assert covered(r.spans) == hit[i] and covered(r.cuts) == cut[i] and r.n_words_repeated == len(hit[i])


def test_op10(run, docs, spark, data):
    model = language_id.fit_documents(spark.read.parquet(f"{data}/documents.parquet"))
    wanted = brute_identify([(i, r.text, None, None, r.source.lower()) for i, r in docs.items()], model)  # every row is in the sample, so none declares
    rows = run("op10_language_id")
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert set(found) == set(docs)
    for i, (lang, confidence, accepted, text_lang) in wanted.items():
        assert (found[i].lang, found[i].accepted, found[i].text_lang) == (lang, accepted, text_lang) and found[i].confidence == pytest.approx(confidence, abs=1e-9)
    pages = {r.page_id: re.search(r'<html lang="(\w+)"', r.html)[1] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert {r.page_id for r in rows if r.page_id is not None} == set(pages)
    assert sum(pages.get(r.page_id) == r.lang for r in rows) > 0.9 * len(pages)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(n) for n in names]
    df = __spark_entry__.queries()[name](spark, data)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in found.fetchall())


def test_whole_tables_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11)) and "pipeline" in names
