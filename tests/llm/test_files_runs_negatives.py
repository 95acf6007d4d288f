"""Token files, periodic runs and hard negatives against plain Python."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstack.llm import coder, negatives, periodic, tokenfiles

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


# Coder and files.


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=80), max_size=6))
def test_blocks_come_back(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    payloads = coder.encode(blocks)
    assert [b.tolist() for b in coder.decode(payloads, [len(b) for b in blocks])] == [b.tolist() for b in blocks]
    # A block does not depend on those beside it.
    assert all(coder.encode([b]) == [p] for b, p in zip(blocks, payloads, strict=True))


def test_coder_learns():
    rng = np.random.default_rng(1)
    zipf = np.minimum(rng.zipf(1.3, 40_000), 49_000).astype(np.uint32)
    counts = np.unique(zipf[:8192], return_counts=True)[1] / 8192
    entropy = -(counts * np.log2(counts)).sum()
    blocks = [zipf[k : k + 8192] for k in range(0, 32_768, 8192)]
    assert sum(map(len, coder.encode(blocks))) * 8 / 32_768 < entropy + 2.5
    again = np.tile(rng.integers(0, 49_000, 500), 16).astype(np.uint32)  # contexts of order 2 name what follows
    assert len(coder.encode([again])[0]) * 8 / len(again) < 2.5
    with pytest.raises(ValueError, match="longer"):
        coder.encode([np.zeros(coder.LONGEST + 1, np.uint32)])


@pytest.fixture
def few_blocks():
    return {"block": 64, "lanes": 3}


def _bytes_encoder():
    """Ids are the bytes of the words; stands in for a tokenizer. A nested function, as workers can't import tests."""

    def encoder():
        def encode(texts, end_id):
            found = [[*b"".join((t or "").encode().split()), end_id] for t in texts.to_pylist()]
            return np.array([i for f in found for i in f], "<u4"), np.array([len(f) for f in found], np.int64)

        return encode

    return encoder


bytes_encoder = _bytes_encoder()


def test_files_hold_what_was_written(spark, tmp_path, few_blocks):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "x"]) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    rows += [(7, "again"), (None, "no id"), (None, None), (90, None), (91, ""), (92, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "name": F.lit("n")}).repartition(4)
    root = f"file://{tmp_path}/ids"
    files = tokenfiles.write_ids(docs, root, bytes_encoder, **few_blocks)
    got = tokenfiles.read_digests(files, root, 2).orderBy("start").collect()
    plain = bytes_encoder()
    want = collections.Counter()
    for i, t in rows:
        ids, _ = plain(pa.array([t]), 2)
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    # Each document by itself, and a damaged block.
    name = files.orderBy("file").first()["name"]
    file = tokenfiles.Reader(root, name)
    for k in range(len(file.docs)):
        ids = file.document(k)
        assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) in {(n, c) for _, n, c in want}
    path = tmp_path / "ids" / name
    data = bytearray(path.read_bytes())
    data[12] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles.Reader(root, name).read(0, 1)
    data[12] ^= 1
    data[-60] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles.Reader(root, name)
    assert tokenfiles.round_trip(docs.limit(0), bytes_encoder).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=80), min_size=1, max_size=6))
def test_blocks_of_words_come_back(blocks):
    blocks = [np.array(b) for b in blocks]
    held, coded = np.unique(np.concatenate(blocks), return_inverse=True)
    counts = np.bincount(coded)
    blocks = np.split(coded, np.cumsum([len(b) for b in blocks])[:-1])
    payloads = coder.encode_words(blocks, counts)
    assert [b.tolist() for b in coder.decode_words(payloads, [len(b) for b in blocks], counts)] == [b.tolist() for b in blocks]
    assert all(coder.encode_words([b], counts) == [p] for b, p in zip(blocks, payloads, strict=True))
    assert coder.decode_words(payloads[-1:], [len(blocks[-1])], counts)[0].tolist() == blocks[-1].tolist()


def test_word_coder_learns():
    rng = np.random.default_rng(1)
    once = rng.integers(0, 1000, 500)
    payload = coder.encode_words([np.tile(once, 16)], np.maximum(np.bincount(once, minlength=1000) * 16, 1))[0]
    assert len(payload) * 8 / 8000 < 2.5  # 9 bits by order 0; orders 1 and 2 name what follows
    with pytest.raises(ValueError, match="more than"):
        coder.encode_words([np.zeros(1, np.int64)], np.array([coder.MOST_WORDS + 1]))


def test_words_are_the_symbols_of_a_file(spark, tmp_path, few_blocks):
    """A word costs one step of the coder, not one for each of its ids."""
    rng = random.Random(3)
    syllables = ["tion", "ea", "th", "ç", "ÉE", "wh"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "", ".", "!?", "'s"]) for _ in range(rng.randrange(120))) for _ in range(30)]
    texts += [None, "", " \n", "x" * 3000 + "1" * 700, "İ 12 <|endoftext|>"]
    encode = tokenfiles.default_encoder()
    root, docs = f"file://{tmp_path}", np.zeros(len(texts), tokenfiles._DOCS)
    codes, ids, ends, docs["ids"] = encode.words(pa.array(texts), 2)
    writer = tokenfiles.Writer(root, "words", **few_blocks)
    writer.add_words(docs[:0], codes[:0], ids, ends)
    writer.add(docs[:0], np.array([7, 70_000], "<u4"))  # ids by themselves may stand between
    writer.add_words(docs, codes, ids, ends)
    writer.close()
    file = tokenfiles.Reader(root, "words")
    want = [[*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert file.read(0, len(file.blocks)).tolist() == [7, 70_000, *(i for w in want for i in w)] and file.ids == sum(map(len, want)) + 2
    assert file.docs["ids"].tolist() == [len(w) for w in want] and len(file.groups) > 2
    assert file.blocks["symbols"].sum() < file.ids / 1.5
    for k in (0, 5, len(file.blocks) - 1):
        at = int(file.blocks["ids"][:k].sum())
        assert tokenfiles.Reader(root, "words").read(k, k + 1).tolist() == [7, 70_000, *(i for w in want for i in w)][at : at + int(file.blocks["ids"][k])]
    path = tmp_path / "words"
    data = bytearray(path.read_bytes())
    data[int(file.starts[file.edges[1]]) - 3] ^= 1  # in the dictionary of the second group
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles.Reader(root, "words").read(0, len(file.blocks))


def test_words_are_encoded_as_in_whole_texts():
    encode = tokenfiles.default_encoder()
    assert encode.apart
    texts = ["It's a tEst\twith\x0bİstanbul ΣΑΣ end", "", None, "<|endoftext|>x <|startoftext|> 's   y z", "don't 123 !!..?? é́ ́a", "a" * 5000, "\n \r"]
    for _ in range(2):  # the second time from memory
        ids, sizes = encode(pa.array(texts), 2)
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_is_encoded_as_a_whole(texts):
    encode = tokenfiles._encoders.setdefault("test", tokenfiles._encoders.get("test") or tokenfiles.default_encoder())
    ids, sizes = encode(pa.array(texts, pa.string()), 2)
    want = [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


@tables
def test_token_files_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op11_token_files"](spark, SF).collect()}
    tokenizer, at = tokenfiles.default_encoder().tokenizer, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got.pop(r.doc_id))[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


# Runs.


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), {}
    for d in range(1, n // 2 + 1):
        i = 0
        while i < n - d:
            j = i
            while j < n - d and w[j] == w[j + d]:
                j += 1
            if j > i and j - i >= d:
                out.setdefault((i, j - 1 + d), d)
            i = max(j, i + 1)
    return sorted((s, e - s + 1, d) for (s, e), d in out.items() if e - s + 1 >= max(least, exponent * d))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(0, 40), st.integers(1, 9), st.sampled_from([2, 4]))
def test_runs(w, at, period, exponent):
    w = [x if i < at else w[at + (i - at) % period] if at + (i - at) % period < len(w) else x for i, x in enumerate(w)]
    want = brute_runs(w, 6, exponent)
    assert periodic.runs(w, 6, exponent) == want
    codes = np.array(w, np.int64)
    inside = [(s + a, n, p) for a, b in periodic.stretches(codes, np.zeros(len(w), np.int64), 6, exponent) for s, n, p in periodic.runs(w[a:b], 6, exponent)]
    assert sorted(inside) == want


def test_end_positions_stay_ordered():
    rng = random.Random(4)
    xs = rng.sample(range(10_000), 3000)
    ends, seen = periodic.Ends(xs[0]), [xs[0]]
    for x in xs[1:]:
        got = ends.add(x)
        assert got == (max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1))
        seen.append(x)
    assert list(ends) == sorted(xs) and max(map(len, ends.pieces)) <= periodic.PIECE


def test_periodic_runs(spark):
    texts = [(1, "x " + "la " * 6 + "y"), (1, "a\tb a\nb a b a b c"), (2, None), (3, " \n"), (None, "z z z z z z"), (4, "b a " * 30000), (5, "one two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit(2)})
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=str)
    want = [(1, [(1, 6, 1)], "x la y"), (1, [(0, 8, 2)], "a b c"), (2, [], ""), (3, [], ""), (None, [(0, 6, 1)], "z"), (4, [(0, 60000, 2)], "b a"), (5, [], "one two")]
    assert got == sorted(want, key=str)
    d = {r.doc_id: r for r in periodic.digest(periodic.periodic_runs(docs.filter("doc_id > 1"))).collect()}
    assert (d[2].n_runs, d[2].start, d[2].exponent_milli) == (0, None, None) and d[4].exponent_milli == 30_000_000
    assert d[2].runs_sha256 == hashlib.sha256(b"").hexdigest() and d[4].collapsed_sha256 == hashlib.sha256(b"b a").hexdigest()
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


@tables
def test_periodic_runs_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, SF).collect()}
    found = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = (r.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 2000:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want, own = brute_runs(w), got[r.doc_id]
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, size, p in want for i in range(s + p, s + size)}
        assert (own.n_runs, own.start, own.length, own.period) == (len(want), *best)
        assert own.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert own.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        assert own.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        found += len(want)
    assert found


# Hard negatives.


def brute_negatives(rows, scale=256):
    rows = {i: (label, [int(np.floor(scale * x)) for x in v]) for i, label, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in sorted(i for i in rows if i % 50 == 0):
        label, x = rows[a]
        scored = sorted((-dot(x, v), i, own) for i, (own, v) in rows.items() if i != a and len(v) == len(x))
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            fit = [(-t, i) for t, i, own in scored if own != label and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
@pytest.mark.parametrize("sparse", [0.05, 1.1, -1])
def test_hard_negatives(spark, monkeypatch, block, sparse):
    monkeypatch.setattr(negatives, "SPARSE", sparse)
    monkeypatch.setattr(negatives, "PARTS", 8)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((4, 6))
    x = centre[rng.integers(0, 4, 300)] + 0.4 * rng.standard_normal((300, 6))
    rows = [(i, int(rng.integers(0, 3)), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    rows[20:40] = [(i, 1, rows[20][2]) for i in range(20, 40)]  # ties
    rows[50] = (50, 2, [0.0] * 6)
    rows += [(1000, 1, [1e5, -3e5, 2.0]), (1001, 1, [1e5, -2e5, 0.0]), (1002, 0, [7e4, -1e5, 1.0]), (1050, 9, []), (1051, 9, []), (1052, 8, [])]
    odd = [(2000, None, [1.0] * 6), (2050, 1, None), (2100, 1, [1.0, None] * 3), (2150, 1, [float("nan")] * 6), (2200, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumns({"x": F.lit(1), "scores": F.lit(2), "anchor": F.lit(3)})
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block, anchors=block // 20).collect())
    assert got == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5))
def test_products_are_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    top = int(rng.choice([1, 300, 1 << 20, 1 << 26]))
    q, x = rng.integers(-top, top + 1, (3, 5)), rng.integers(-top, top + 1, (n, 5))
    i, j, score = negatives.products(q, negatives.Planes(x), np.ones((3, n), bool), negatives.First(k))
    whole = q @ x.T
    assert (score == whole[i, j]).all()
    for a in range(3):
        best = sorted(whole[a])[-k:]
        assert set(np.flatnonzero(whole[a] >= best[0])) == set(j[i == a])


def test_scores_beyond_64_bits_are_refused():
    big = np.full((1, 4), 1 << 40)
    with pytest.raises(ValueError, match="64 bits"):
        negatives.products(big, negatives.Planes(big), np.ones((1, 1), bool), negatives.First(1))


@tables
def test_negatives_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(entry.oracle_sql()["op13_hard_negatives"])
    got = entry.queries()["op13_hard_negatives"](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
