"""Each operator against a brute-force version, and in the odd cases: nulls, empty and long texts, ties,
repeated rows, empty tables, columns whose names clash."""

import base64
import html
import random
import re
from collections import Counter, defaultdict
from datetime import date
from hashlib import sha256
from math import log
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import byte_bpe, components, decontaminate, hilbert_ann, html_text, language_id, ngram_lm, simhash, suffix_dedup, token_files, toxicity
from strata.llm.common import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = P.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n", "a", "One two three four.", "é ß 日本 ŉ  x", "x" * 5000, " ".join(["the"] * 3000)]


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\t0é日"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_is_tiktoken(tiktoken_encoding, text):
    own = byte_bpe.tokenizer(BPE, P.PATTERN)
    ids = own.encode(text)
    assert ids == tiktoken_encoding.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_long_texts_in_segments(tiktoken_encoding, monkeypatch):
    own = byte_bpe.tokenizer(BPE, P.PATTERN)
    text = " ".join(prose(1, 300).split()) + "  \n x's don't  " + "ab" * 4000 + " end"
    monkeypatch.setattr(byte_bpe, "SEGMENT", 17)
    assert own.encode(text) == tiktoken_encoding.encode_ordinary(text)


def test_bpe_rows(spark, tiktoken_encoding):
    docs = frame(spark, [*ODD, ODD[4]], [*range(len(ODD)), 4])
    rows = byte_bpe.round_trip(docs, BPE, P.PATTERN).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        t = ODD[r.doc_id] or ""
        ids = tiktoken_encoding.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(docs, BPE, P.PATTERN), BPE, P.PATTERN)
    assert back.columns == [*docs.columns, "ids", "bytes"]
    assert all(r.bytes.decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.round_trip(docs.where("false"), BPE, P.PATTERN).count() == 0


def test_bpe_matches_and_merges_only_what_is_new(monkeypatch, tiktoken_encoding):
    """Words that are remembered are not matched by the pattern again, and new ones share queues."""
    own = byte_bpe.ByteBPE(byte_bpe.read_ranks(BPE), P.PATTERN)
    matched, queues, pieces, merge = [], [], own.pieces, own.merge
    monkeypatch.setattr(own, "pieces", lambda text: matched.append(len(text)) or pieces(text))
    monkeypatch.setattr(own, "merge", lambda new: queues.append(len(new)) or merge(new))
    text = ", ".join(prose(1, 5000).split()) + "  \n" + " ".join(f"zqxv{i:x}" for i in range(1000))
    assert own.encode(text) == tiktoken_encoding.encode_ordinary(text)
    assert sum(matched) < len(text) / 2 and len(queues) < 10
    matched.clear(), queues.clear()
    assert own.encode(text) == tiktoken_encoding.encode_ordinary(text)
    assert sum(matched) < 100 and not queues


def brute_bpe(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=60), st.randoms(), st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=12))
def test_bpe_of_pieces_in_one_queue(tokens, r, words):
    """Each piece as if alone, whatever the ranks: also where a longer token has the lower one."""
    tokens = [b"a", b"b", b"c", *sorted(tokens)]
    r.shuffle(tokens)
    ranks = {t: 7 * i for i, t in enumerate(tokens)}
    own = byte_bpe.ByteBPE(ranks, r"\w+")
    got = [np.frombuffer(ids, np.int32).tolist() for ids in own.merge([w.encode() for w in words])]
    assert got == [brute_bpe(ranks, w.encode()) for w in words]
    with pytest.raises(KeyError):
        own.merge([b"ab", b"ad"])


def test_bpe_of_a_long_piece_of_falling_ranks():
    """Each merge makes a pair of a lower rank; a queue whose rest were looked at again each time would be quadratic."""
    own = byte_bpe.ByteBPE({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4, b"abcabc": 5}, r"\w+")
    assert own.encode("abc" * 200_000) == [5] * 100_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "\u3000", "a", "ab", "é", "日本", "12", "'s", "'", ",", "--", "don't", "²", "\u0301", "x" * 60]), max_size=30))
def test_bpe_of_words_and_white_space(tiktoken_encoding, parts):
    own, text = byte_bpe.tokenizer(BPE, P.PATTERN), "".join(parts)
    assert own.encode(text) == tiktoken_encoding.encode_ordinary(text)
    pattern = "[^a]+|a+"  # with matches that cross spaces
    library = type(tiktoken_encoding)("other", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    assert byte_bpe.tokenizer(BPE, pattern).encode(text) == library.encode_ordinary(text)


# token files


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "hello <|endoftext|> <|startoftext|> world", "<|ENDOFTEXT|>a<|endoftext|>B", "<|Endoftext|>", "İstanbul é <|endoftext|> can't\x1cx\x85y", prose(3, 500)]
    docs = frame(spark, [*texts, texts[4]], [*range(len(texts)), 4]).unionByName(frame(spark, ["no id"], [None])).withColumnRenamed("source", "h")
    store = shared_path(spark, "test-tokens")
    token_files.write(docs.repartition(3), store, path, end_id=1)
    rows = token_files.read(spark, store, ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 4, None], key=lambda x: (x is not None, x or 0))
    start = 0
    for r in rows:
        ids = t.encode("no id" if r.doc_id is None else texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = shared_path(spark, "test-tokens")
    token_files.write(docs.where("false"), empty, path, end_id=1)
    assert token_files.read(spark, empty).count() == 0


def test_words_of_token_files_are_the_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    loaded, library = token_files.load(path), Tokenizer.from_file(path)
    assert loaded.words is not None and loaded.words.cuts_words
    r = random.Random(4)
    letters = [*"aAbB'sStT re ll!!?..#=1 23_-é É Ø ß İ ŉ ǅ ñ × ÷ ª ² \u0338 \u0301 \u0308 日 \x1c\x85  <|> x", "the ", "Word, "]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(r.choice([*letters, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]) for _ in range(20)) for _ in range(300)]
    r.shuffle(texts)
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        ids, n = token_files.encode_texts(loaded, [t.encode() for t in part])
        for text, own in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text
    ids, n = token_files.encode_texts(loaded, [b"", b""])
    assert len(ids) == 0 and n.tolist() == [0, 0]


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(spark):
    texts = [*ODD, "One two three four.", "ONE two\tthree four."] + [prose(i // 3, 400) + f" tail{i}" for i in range(30)]
    rows = simhash.near_duplicates(spark, frame(spark, texts)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == find(r.doc_id)


def test_simhash_links_of_dense_and_far_fingerprints(spark):
    r = random.Random(5)
    values = set()
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for b in r.sample(range(64), r.randrange(0, 4)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for cap in (10**6, 3):
        found = {x.vertex & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in components.components(spark, simhash.links(spark, df, shard_cap=cap)).collect()}
        groups = defaultdict(set)
        for v in values:
            groups[found.get(v, v)].add(v)
        wanted = defaultdict(set)
        for v in values:
            wanted[find(v)].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    found = {r.vertex: r.root for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_keeps_one(spark):
    texts = ["same text here today", "same text here today", "other words are these", None, "", prose(1, 50)]
    docs = frame(spark, [*texts, texts[0]], [0, 1, 2, 3, 4, 5, 0])
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5]
    assert simhash.keep_one(spark, docs.where("false")).count() == 0
    assert simhash.keep_one(spark, frame(spark, ["a b c d", "a b c d"], [None, None])).count() == 2


# suffix arrays


def brute_repeats(texts, width):
    windows, words = defaultdict(list), {}
    for i, t in texts:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(words[i]) - width + 1):
            windows[tuple(words[i][k : k + width])].append((i, k))
    hit, cut = defaultdict(set), defaultdict(set)
    for places in windows.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                hit[i].update(range(k, k + width))
                if (i, k) != min(places):
                    cut[i].update(range(k, k + width))
    return hit, cut


def test_suffix_dedup_is_exact(spark):
    r = random.Random(2)
    shared = [prose(100 + i, 70) for i in range(4)]
    texts = [*ODD]
    for i in range(25):
        parts = [prose(i, r.randrange(5, 80))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(shared).split()
            low = r.randrange(0, 30)
            parts += [" ".join(p[low : low + r.randrange(20, 70)]), prose(1000 + i, r.randrange(0, 9), 30)]
        texts.append(" ".join(parts))
    texts += [texts[-1], shared[0] + " " + shared[0], " ".join(["the"] * 400)]
    hit, cut = brute_repeats(list(enumerate(texts)), 50)
    assert hit
    docs = frame(spark, texts)
    covered = lambda spans: {k for s in spans for k in range(s.start, s.end)}
    for hot in (suffix_dedup.HOT, 8, 0):
        found = {x.doc_id: x for x in suffix_dedup.repeats(spark, docs.repartition(5), hot=hot).collect()}
        assert set(found) == set(hit)
        for i, x in found.items():
            assert covered(x.spans) == hit[i] and covered(x.cuts) == cut[i]
    kept = {x.doc_id: x for x in suffix_dedup.cut_repeats(spark, docs).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        left = [w for k, w in enumerate(words) if k not in cut[i]]
        if not cut[i]:
            assert kept[i].text == t
        elif left:
            assert re.findall(r"[^\x20\x09-\x0D]+", kept[i].text) == left and kept[i].n_chars == len(kept[i].text)
        else:
            assert i not in kept
    assert suffix_dedup.repeats(spark, docs.where("false")).count() == 0


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    p = prose(9, 60)
    docs = frame(spark, [p, p, "own " + p, p + " more"], [3, 3, 5, None])
    found = {x.doc_id: x for x in suffix_dedup.repeats(spark, docs).collect()}
    assert set(found) == {3, 5, None}
    assert found[None].cuts == [] and found[5].cuts and found[3].cuts
    assert suffix_dedup.repeats(spark, frame(spark, [p, p], [1, 1])).count() == 0


@pytest.mark.parametrize("kind", ["string", "double", "date", "int"])
def test_suffix_dedup_ids_of_any_type(spark, kind):
    p = prose(9, 60)
    ids = {"string": ["", "b", None, "a"], "double": [0.5, 2.0, None, 1.0], "date": [date(2020, 1, 1), date(2020, 1, 3), None, date(2020, 1, 2)], "int": [0, 2, None, 1]}[kind]
    docs = spark.createDataFrame(list(zip(ids, [p, "x " + p, p + " y", prose(3, 60)], strict=True)), f"doc_id {kind}, text string")
    for hot in (0, 5_000):
        found = {x.doc_id: x for x in suffix_dedup.repeats(spark, docs, hot=hot, group=2).collect()}
        assert set(found) == set(ids[:3]) and {x.first_doc_id for x in found.values()} == {None}
        assert found[None].cuts == [] and all(found[i].cuts == [(k, k + 60)] for k, i in enumerate(ids[:2]))
        found = {x.doc_id: x.first_doc_id for x in suffix_dedup.repeats(spark, docs.dropna(), hot=hot).collect()}
        assert found == {ids[0]: ids[0], ids[1]: ids[0]}


def test_suffix_dedup_of_passages_between_other_minimisers(spark):
    r, passages = random.Random(6), [prose(40 + i, 64, 10**6).split() for i in range(40)]
    texts = [" ".join(w for _ in range(12) for w in [*prose(r.random(), 9, 10**6).split(), *r.choice(passages)[r.randrange(9) :][: r.randrange(48, 60)]]) for _ in range(30)]
    hit, cut = brute_repeats(list(enumerate(texts)), 50)
    for hot in (0, 5_000):
        found = {x.doc_id: x for x in suffix_dedup.repeats(spark, frame(spark, texts), hot=hot).collect()}
        assert set(found) == set(hit)
        for i, x in found.items():
            assert {k for s in x.spans for k in range(s.start, s.end)} == hit[i] and {k for s in x.cuts for k in range(s.start, s.end)} == cut[i]


def test_suffix_dedup_splits_a_passage_of_many_documents(spark):
    r, p = random.Random(4), prose(9, 75).split()
    texts = [" ".join([*prose(20 + i, r.randrange(3, 30), 10**6).split(), *p[r.randrange(3) :], *prose(900 + i, 20, 10**6).split()]) for i in range(150)]
    texts += texts[:40]
    hit, cut = brute_repeats(list(enumerate(texts)), 50)
    for group in (7, 64, 10_000):
        found = {x.doc_id: x for x in suffix_dedup.repeats(spark, frame(spark, texts).repartition(3), hot=20, group=group).collect()}
        assert set(found) == set(hit)
        for i, x in found.items():
            assert {k for s in x.spans for k in range(s.start, s.end)} == hit[i] and {k for s in x.cuts for k in range(s.start, s.end)} == cut[i]


# decontamination


def test_decontaminate_both_ways(spark):
    items = [(0, prose(1, 20)), (1, "Short one here"), (2, "single"), (3, ""), (4, None), (5, prose(1, 12)), (6, prose(2, 9)), (6, prose(7, 9)), (None, prose(8, 10))]
    r = random.Random(3)
    texts = [*ODD, "a SINGLE: short, one; here"]
    for i in range(40):
        t = prose(50 + i, r.randrange(0, 60), 2000)
        for _, item in r.sample(items, 2):
            w = (item or "").split()
            low = r.randrange(0, 4)
            t += " " + " ".join(w[low : low + r.randrange(3, 20)]).upper() + " " + prose(i, 2, 2000)
        texts.append(t)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[k : k + 8])].add(None if i is None else str(i))
    docs = frame(spark, texts).unionByName(frame(spark, [texts[9]], [9]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = [decontaminate.decontaminate(docs, benchmark, broadcast_bytes=b).collect() for b in (1 << 20, 0)]
    assert sorted(both[0], key=repr) == sorted(both[1], key=repr) and len(both[0]) == len(texts) + 1
    for x in both[0]:
        w = word.findall(lower(texts[x.doc_id]))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own - {None}
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(found), len(found) >= 2)
        assert x.items_sha256 == sha256(",".join(sorted(found)).encode()).hexdigest()
    bad = {x.doc_id for x in both[0] if x.contaminated}
    assert bad
    for b in (1 << 20, 0):
        kept = decontaminate.keep_clean(docs, benchmark, broadcast_bytes=b)
        assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in both[0] if x.doc_id not in bad)
    assert decontaminate.decontaminate(docs.where("false"), benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_keep_clean_judges_each_row_by_its_text(spark):
    benchmark = spark.createDataFrame([(0, prose(1, 12)), (1, prose(2, 12))], "item_id long, text string")
    bad, clean = prose(1, 12) + " and " + prose(2, 12), prose(3, 30)
    docs = frame(spark, [bad, clean, bad, clean, None, bad, clean, clean], [1, 1, None, None, None, 2, 3, 3]).withColumnRenamed("source", "h")
    wanted = [(1, clean), (3, clean), (3, clean), (None, clean), (None, None)]
    for b in (1 << 20, 0):
        kept = decontaminate.keep_clean(docs, benchmark, broadcast_bytes=b)
        assert kept.columns == docs.columns
        assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted(wanted, key=repr)


# language model


def test_stupid_backoff_is_exact(spark):
    texts = [*ODD, *[prose(i, 60, 12) for i in range(12)]]
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) for t in texts]
    grams = lambda w, k: zip(*(w[i:] for i in range(k)), strict=False)
    total = Counter(g for w in words for k in (1, 2, 3) for g in grams(w, k))
    n = sum(map(len, words))
    docs = frame(spark, texts)
    results = [{r.doc_id: r for r in ngram_lm.score(spark, d, block_words=b, bucket_grams=g).collect()} for d, b, g in ((docs, 10**6, 10**6), (docs.repartition(3), 40, 100))]
    for i, w in enumerate(words):
        own = Counter(g for k in (1, 2, 3) for g in grams(w, k))
        score = 0.0
        for at in range(len(w)):
            for k in (3, 2, 1):
                if at - k + 1 < 0:
                    continue
                g = tuple(w[at - k + 1 : at + 1])
                c = total[g] - own[g]
                if k == 1:
                    score += 2 * log(0.4) + log(max(c, 0.5)) - log(n - len(w))
                elif c > 0:
                    score += (3 - k) * log(0.4) + log(c) - log(total[g[:-1]] - own[g[:-1]])
                    break
        for found in results:
            assert found[i].n_words == len(w) and found[i].log_prob == pytest.approx(score)
    assert ngram_lm.score(spark, docs.where("false")).count() == 0


# neighbours


def test_hilbert_curve_steps_to_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[i % 12] + 0.3 * rng.standard_normal(16) for i in range(3000)]).reshape(-1, 16)
    x[50:400] = x[100]  # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5100, [float("nan")] * 16), (5200, [1.0] * 15 + [float("inf")]), (5300, [1.0, None] * 8), (5400, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumnRenamed("embedding", "embedding")
    found = defaultdict(list)
    for r in hilbert_ann.nearest(spark, df, bucket=128).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id, r["rank"]))
    assert set(found) == set(range(0, 3000, 100))
    right = total = 0
    for q, own in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        wanted = np.lexsort((np.arange(len(x)), d))[:10]
        assert [r for _, _, r in own] == list(range(1, 11)) and own == sorted(own)
        assert all(s == pytest.approx(d[v], abs=1e-12) for s, v, _ in own)
        right += len({v for _, v, _ in own} & set(wanted.tolist()))
        total += 10
    assert right / total >= 0.9
    assert [v for _, v, _ in found[100]] == list(range(50, 60))
    wide = found
    with pytest.MonkeyPatch.context() as m:
        m.setattr(hilbert_ann, "MOST_BUCKETS", 5)  # so that buckets have parts
        found = defaultdict(list)
        for y in hilbert_ann.nearest(spark, df, bucket=128).orderBy("query_id", "rank").collect():
            found[y.query_id].append((y.score, y.vec_id, y["rank"]))
    assert set(found) == set(wide) and sum(len(set(found[q]) & set(wide[q])) for q in wide) >= 0.9 * total
    few = hilbert_ann.nearest(spark, df.where("vec_id <= 3")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert hilbert_ann.nearest(spark, df.where("false")).count() == 0


# HTML


def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=x>Menu</a></nav><div id="cookie-notice"><p>We use cookies, many of them, for reasons that we like to explain.</p></div>
    <div class=content><h1>Head &amp; line</h1><p>First   para&shy;graph, with commas, and more words than that, you know.<p>Second<br>one is long, too, and is here.
    <ul><li>one<li>two &lt;b&gt;</ul><table><tr><td>c1<td>c2</table><form>Search<input></form><script>var a = "</p>";</script><blockquote>Q</blockquote></div>
    <aside><p>Aside text, which is quite long as well, and has some commas, too.</p></aside>
    <section id="comments"><p>I, as a reader, think, well, that this is all very nice, indeed, yes.</p></section><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nFirst para­graph, with commas, and more words than that, you know.\nSecond one is long, too, and is here.\none\ntwo <b>\nc1\nc2\nQ"


def test_html_names_are_hints():
    real = "<p>A long paragraph of real text, with commas, and more of it, that tells what the page is about, really.</p>"
    assert html_text.main_text(f"<div id='share-price-analysis'>{real}</div><p>x y z</p>").startswith("A long paragraph")
    for name in ("sidebar", "comments", "comment-list", "share-buttons", "user-comments", "ad", "cookieNotice", "related-posts"):
        page = f"<div><p>{'Main text, with commas, that goes on. ' * 4}</p></div><div class='{name}'>{real * 5}</div>"
        assert "real text" not in html_text.main_text(page), name
    page = f"<div><p>{'Main text, with commas, that goes on. ' * 9}</p></div><div class='related-rubric'>{real}</div>"
    assert "real text" not in html_text.main_text(page)  # other words too, but the smaller part of the page


def test_html_scoring_without_an_article():
    """Paragraphs' points choose the container, beside blocks of links and short notes."""
    r = random.Random(5)
    for _ in range(40):
        body = [" ".join(r.choice("alpha beta gamma delta, epsilon zeta, eta theta".split()) for _ in range(r.randrange(20, 60))) + "." for _ in range(r.randrange(3, 8))]
        links = "".join(f"<li><a href='/{k}'>{prose(k, 6)}</a></li>" for k in range(12))
        inner = "".join(f"<p>{x}</p>" for x in body)
        page = f"<html><body><div><ul>{links}</ul></div><div><div>{inner}</div></div><div><p>short note</p></div></body></html>"
        assert html_text.main_text(page) == "\n".join(" ".join(x.split()) for x in body)


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<!-- x", "<script>x", "</p></div>", "<div " * 50, '<a href="x>y', "<p>" * 3000 + "x", "<div>" * 20000 + "deep text, really deep, isn't it, yes" + "</div>" * 20000, "&#x110000; &notanentity; &amp"])
def test_html_broken_pages(page):
    text = html_text.main_text(page)
    assert "\n\n" not in text and text == text.strip()


def test_html_articles_of_the_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        low = r.html.index("<article>") + 9
        high = r.html.find("</article>")
        body = re.sub(r"<[^>]*$", "", r.html[low : high if high >= 0 else len(r.html)])
        blocks = [re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b) for b in re.split(r"</?(?:p|h1)>", body)]
        assert found[r.page_id] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
    odd = spark.createDataFrame([(1, None, "u", "kept"), (2, "", "u", "kept")], "page_id long, html string, url string, text string")
    assert [(r.page_id, r.text) for r in html_text.extract(odd).orderBy("page_id").collect()] == [(1, ""), (2, "")]


# language


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), "lang")
    keyed = docs.where("doc_id % 2 = 1")
    found = language_id.identify(spark, keyed, model, ["doc_id"], host=keyed.source).join(docs.select("doc_id", docs.lang.alias("truth")), "doc_id").collect()
    assert sum(r.lang == r.truth for r in found) / len(found) > 0.97


def test_language_evidence(spark):
    rows = [(i, " ".join(["der die das und nicht", "the of and to in"][i % 2].split() * 5), "de" if i % 2 == 0 else "en", f"h{i % 2}.site.org", "de" if i % 2 == 0 else "en") for i in range(80)]
    rows += [(100, "zzz", "de", "h0.site.org", None), (101, "12 %%", "de", "h0.site.org", None), (102, None, None, None, None), (103, "", "en", "x", "en"), (104, "qqqq", None, "h1.site.org", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, lang string")
    model = language_id.fit(df, "lang")
    found = {r.doc_id: r for r in language_id.identify(spark, df, model, ["doc_id"], declared=df.declared, suffix=df.host, host=df.host).collect()}
    assert len(found) == len(rows) and all(found[i].lang == ("de" if i % 2 == 0 else "en") for i in range(80))
    assert found[100].lang == "de" and found[104].lang == "en"  # the host and the declaration tell
    assert not any(found[i].accepted for i in (101, 102, 103))
    assert language_id.identify(spark, df.where("false"), model, ["doc_id"], host=df.host).count() == 0
    docs = df.select("doc_id", "text", "lang", df.host.alias("source"), df.doc_id.alias("n_chars"), df.host.alias("n"))
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(80), 100, 104]
    assert language_id.keep_identified(spark, docs.where("false")).count() == 0


def brute_identify(rows, model):
    """(key, text, declared, suffix, host) rows by the formulas of the module's docstring, one by one."""
    size, S, T = len(model.languages), language_id.STRENGTH, language_id.TEMPER
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    read = []
    for key, text, *evidence in rows:
        n, ll = model.score((text or "").encode())
        p = soft(T * ll)
        best = int(np.argmax(p)) if n else None
        read.append((key, n, T * ll if n else np.zeros(size), best, n and p.max() >= language_id.CLEAR, evidence))
    clear = [(best, e) for _, _, _, best, ok, e in read if ok]
    whole = Counter(i for i, _ in clear)
    overall = np.array([(whole[i] + 1) / (len(clear) + size) for i in range(size)])

    def counts(of):
        m = defaultdict(lambda: np.zeros(size))
        for i, e in clear:
            if of(e) is not None:
                m[of(e)][i] += 1
        return m

    found = {}
    for key, n, ll, best, _, e in read:
        logs, unknown = ll.copy(), log(language_id.UNKNOWN) - n * T * log(language_id.FEATURES)
        for c in (0, 1):
            m = counts(lambda x: x[c])  # noqa: B023
            if e[c] in m:
                seen = sum(m.values())
                logs += np.log((m[e[c]] + S * m[e[c]].sum() / seen.sum()) / (seen + S))
                unknown += log(m[e[c]].sum() / seen.sum())
        prior = overall
        if e[2] is not None:
            for width in (*language_id.DOMAINS, None):
                up = lambda h: None if h is None or width is not None and h.count(".") < width else ".".join(h.split(".")[-width:]) if width else h  # noqa: B023, E731
                if up(e[2]) is not None:
                    m = counts(lambda x: up(x[2]))[up(e[2])]  # noqa: B023
                    prior = (m + S * prior) / (m.sum() + S)
        post = soft([*(logs + np.log(prior)), unknown])
        confidence = post[:size].max()
        accepted = bool(confidence >= language_id.CONFIDENCE and n)
        found[key] = (model.languages[int(np.argmax(post[:size]))] if accepted else None, confidence, accepted, None if best is None else model.languages[best])
    return found


def test_posteriors_are_the_formulas(spark, data):
    r = random.Random(12)
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 3 = 0"), "lang")
    rows = []
    for x in docs:
        text = " ".join((x.text or "").split()[: r.choice([1, 2, 5, 40])])
        host = r.choice([None, "a.b.example.org", f"{x.lang}.b.example.org", f"www.{x.lang}.b.example.org", f"m.blog.{x.lang}.example.net", x.lang, "y.z"])
        rows.append((x.doc_id, text, r.choice([None, x.lang, x.lang, "en", "tlh"]), host and host.rsplit(".", 1)[-1], host))
    rows += [(-1, "xq zzv", "fr", "net", "new.fr.example.net"), (-2, None, "fr", None, None), (-3, "", None, None, "a.b.c.d.e.f.g"), (-4, "123", "de", "org", "a.b.example.org")]
    df = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string")
    wanted = brute_identify(rows, model)
    got = {x.key: x for x in language_id.identify(spark, df, model, ["key"], declared=df.declared, suffix=df.suffix, host=df.host).collect()}
    assert set(got) == set(wanted)
    for key, (lang, confidence, accepted, text_lang) in wanted.items():
        x = got[key]
        assert (x.lang, x.accepted, x.text_lang) == (lang, accepted, text_lang) and abs(x.confidence - confidence) < 1e-9
    plain = {x.key: x for x in language_id.identify(spark, df, model, ["key"]).collect()}
    assert any(plain[k].lang != got[k].lang and got[k].accepted for k in got)  # the evidence changes results
    twice = language_id.identify(spark, df.unionByName(df), model, ["key"]).groupBy("key").count().where("count <> 2")
    assert twice.count() == 0


def test_pages_and_labels_as_evidence(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit_documents(docs)
    page = lambda lang, text: f"<!DOCTYPE html><HTML class=x LANG='{lang}-XX'><body><article><p>{text}</p></article></body></html>"
    texts = {x.lang: " ".join(x.text.split()[:60]) for x in docs.where("n_chars > 500").collect()}
    rows = [(i, f"https://u@www.{k}.example.org:80/p?x", page(k, t)) for i, (k, t) in enumerate(sorted(texts.items()) * 8)]
    rows += [(100, "http://www.fr.example.org/", page("fr", "Zq xvz")), (101, None, None), (102, "no address", "<p>"), (103, "http://new.www.fr.example.org/", page("fr", "Zq xvz"))]
    found = {x.page_id: x for x in language_id.identify_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(found) == len(rows) and all(found[i].lang == k for i, k in enumerate(sorted(texts) * 8))
    assert found[103].lang == "fr" and not found[101].accepted and not found[102].accepted
    assert language_id.identify_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string").where("false"), model).count() == 0
    bare = language_id.fit(docs, "lang", per_language=3)
    assert 0 < docs.where(bare.fitted_on(docs.lang, docs.doc_id)).count() < docs.count() / 4
    assert docs.where(~model.fitted_on(docs.lang, docs.doc_id)).count() == docs.where("trim(lang) = '' or lang is null").count()


def test_every_language_is_fitted(spark):
    r = random.Random(10)
    names = [f"x{i}" for i in range(90)] + ["en"]
    vocabulary = {k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 8))) for _ in range(12)] for k in names}
    rows = []
    for k in names:
        for j in range(8 if k < "x70" else 4):
            tag = ("en", "EN", " En ", "eN")[j % 4] if k == "en" else k
            rows.append((len(rows), " ".join(r.choice(vocabulary[k]) for _ in range(60)), tag, "src0", 1))
    docs = spark.createDataFrame([*rows, (9999, "no label here", " ", "src0", 1)], DOCS)
    model = language_id.fit(docs, "lang")
    assert model.languages == sorted(names)
    found = {x.doc_id: x for x in language_id.identify(spark, docs, model, ["doc_id"]).collect()}
    assert all(found[i].text_lang == found[i].lang == tag.strip().lower() for i, _, tag, _, _ in rows)
    found = {x.doc_id: x for x in language_id.identify_documents(spark, docs).collect()}
    assert all(found[i].lang == tag.strip().lower() for i, _, tag, _, _ in rows)


def test_sparse_weights_are_the_dense_ones(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    dense = language_id.fit(docs, "lang")
    monkeypatch.setattr(language_id, "DENSE", 1)
    sparse = language_id.fit(docs, "lang")
    assert sparse.base is not None and dense.base is None and sparse.languages == dense.languages
    for r in docs.limit(50).collect():
        (n, x), (m, y) = (model.score((r.text or "").encode()) for model in (dense, sparse))
        assert n == m and np.allclose(x, y, rtol=1e-5)


def test_junk_and_other_languages_are_rejected(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    r = random.Random(11)
    junk = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60))
    other = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"
    rows = [(-1, junk, "en", "src0", 1), (-2, other, "en", "src0", 1), (-3, junk, None, None, 1), (-4, other, None, None, 1)]
    model = language_id.fit(docs, "lang")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    found = {x.doc_id: x for x in language_id.identify(spark, both, model, ["doc_id"], declared=both.lang, host=both.source).collect()}
    assert not any(found[i].accepted for i in (-1, -2, -3, -4))
    assert all(found[x.doc_id].accepted for x in docs.collect() if re.search("[a-zA-Z\x80-\U0010ffff]", x.text or ""))


# toxicity


def test_restoring(spark, data):
    model = toxicity.CharacterModel(toxicity.character_counts(spark.read.parquet(f"{data}/documents.parquet").unionByName(frame(spark, ["such an idiot and a moron, stupid people"] * 50))))
    for written, meant in (("id1ot", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("idi0t", "idiot")):
        assert toxicity.restore(written, model) == meant
    assert toxicity.words_of("idiot###", model) == ["idiot"] and toxicity.words_of("(thing)", model) == ["thing"]


def test_toxicity_scores(spark):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(i, 30).split()
        if toxic:
            words[r.randrange(30)] = r.choice(["idiot", "moron", "id1ot", "i d i o t"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts += ODD
    docs = frame(spark, texts)
    given = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(spark, docs, given).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert x.held_out == (crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    held = [(x.predicted, labels[x.doc_id][1]) for x in rows if x.held_out and x.doc_id < 900]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    none = toxicity.toxicity(spark, docs, given.where("false")).collect()
    assert len(none) == len(texts)
    assert toxicity.toxicity(spark, docs.where("false"), given).count() == 0


def test_restore_is_the_best_path_of_the_lattice(spark):
    """Against the best of all readings of short tokens."""
    from itertools import product

    model = toxicity.CharacterModel(toxicity.character_counts(frame(spark, [prose(i, 50) + " the idiot said that this is a stupid house and it was" for i in range(5)])))

    def cost(parts):
        x = y = 0
        total = 0.0
        for text, c in parts:
            total += c
            for ch in text:
                z = toxicity.symbol(ch)
                if z == 0 and y == 0:
                    continue
                total += model.logs[x][y][z]
                x, y = y, z
        return total

    r = random.Random(13)
    for _ in range(400):
        token = "".join(r.choice("abdeiosthu01345$@!.-_ *") * r.choice([1, 1, 1, 3]) for _ in range(r.randrange(1, 6)))
        for breaks in (True, False):
            lattice = [*toxicity.lattice(token, breaks), [(" ", 0.0)]]
            best = max(cost(p) for p in product(*lattice))
            own = toxicity.restore(token, model, breaks)
            readings = [p for p in product(*lattice) if "".join(t for t, _ in p).strip() == own]
            assert readings and max(map(cost, readings)) > best - 1e-9, token


def test_toxicity_sample_is_bounded(spark):
    docs = frame(spark, [f"word{i % 7} text" for i in range(300)] * 2, [*range(300)] * 2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    found = toxicity.toxicity(spark, docs, labels, max_rows=40)
    assert found.count() == 600 and found.select("doc_id", "score").distinct().count() == 300


def test_toxicity_of_every_disguise(spark):
    r = random.Random(6)
    plain = "the of and to in is that it was for on are with as his they be at one have this from word what some we can out other were all there when up use your how said each she which their time will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find head".split()
    bad = ["idiot", "moron", "stupid", "shit"]
    prose_of = lambda: [r.choice(plain) for _ in range(40)]
    texts, labels = [], []
    for i in range(800):
        words = prose_of()
        if i % 4 == 0:
            words[r.randrange(40)] = bad[i // 4 % 4]
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    known = frame(spark, texts)
    model = toxicity.fit(known, spark.createDataFrame(labels, "doc_id long, toxic int"))
    disguises = ["sh1t-head", "you,id1ot", "5h17", "1d107", "i,d,i,o,t", "i/d/i/o/t", "i\\d\\i\\o\\t", "st_u_pid", "mo.ron", "1 d 1 0 t", "what a 1 d 1 0 t 2", "3 i d i o t s", "$ t u p 1 d", "i, d, i, o, t", "m · 0 · r · 0 · n", "sh1t's", "(1d10t!)", "sh!+", "st-up1d", "id1ot", "m.o.r.o.n", "stuuuupid", "i d i o t"]
    clean = ["head-long", "time,water", "2024", "10,000", "1 2 3 4 5", "1,2,3", "find/see", "(thing)", "don't", "2 a 3", "a b c", "they're,no"]
    planted = []
    for x in [*disguises, *clean]:
        words = prose_of()
        words[20] = x
        planted.append(" ".join(words))
    found = {x.doc_id: x.predicted for x in toxicity.score(frame(spark, planted), model).collect()}
    wrong = [x for i, x in enumerate([*disguises, *clean]) if found[i] != (i < len(disguises))]
    assert not wrong
    assert toxicity.words_of("sh1t-head", model.characters)[:2] == ["shit", "head"] and toxicity.words_of("10,000", model.characters) == []
    assert toxicity.words_of("i,d,i,o,t", model.characters) == ["idiot"] and "idiot" in toxicity.words_of("1d107", model.characters)
