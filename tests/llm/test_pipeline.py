"""The pipeline against a brute-force run of its stages over the same rows."""

from hashlib import sha256

import public_tokenizers as P

import corpus_pipeline
from strata.llm import byte_bpe
from test_operators import brute_fingerprint, brute_repeats, lower  # noqa: F401

import re
from collections import defaultdict


def test_run(spark, data):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if re.search("[a-zA-Z\x80-\U0010ffff]", t)}
    fps = {i: brute_fingerprint(t) for i, t in kept.items()}
    label = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            for j in kept:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    kept = {i: t for i, t in kept.items() if label[i] == i}
    _, cut = brute_repeats(sorted(kept.items()), 50)
    texts = {}
    for i, t in kept.items():
        if cut[i]:
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            out, low = [], 0
            for k, (start, _) in enumerate(at):
                if k in cut[i] and k - 1 not in cut[i]:
                    out.append(t[low:start])
                if k not in cut[i] and k - 1 in cut[i]:
                    low = start
            if len(at) - 1 not in cut[i]:
                out.append(t[low:])
            t = "".join(out).strip()
            if not t:
                continue
        texts[i] = t
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[k : k + 8])].add(r.item_id)
    wanted = {}
    bpe = byte_bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i, t in texts.items():
        w = word.findall(lower(t))
        items = set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                items |= windows.get(tuple(w[k : k + size]), set())
        if not items:
            wanted[i] = (len(bpe.encode(t)), sha256(t.encode()).hexdigest())
    assert len(wanted) < len(texts)  # every stage has something to do
    assert {i: (r.n_tokens, r.decoded_sha256) for i, r in rows.items()} == wanted


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
