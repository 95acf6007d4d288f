"""Vectorised kernels and whole operators against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import common, decontam, kneserney, minhash, packing, quality, secrets, suffixes, toxicity, urlfilter, vectors
from quillstack.llm.components import components

_texts = st.lists(st.text(alphabet="ab é\n\t.", max_size=30), max_size=6)


@settings(max_examples=60, deadline=None)
@given(_texts)
def test_words_and_shingles(texts):
    data, offsets = common.flat(pa.array([*texts, None], pa.string()))
    hashes, rows = common.word_hashes(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert rows.tolist() == [i for i, _ in want]
    by = collections.defaultdict(set)
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    _, own = common.shingle_hashes(hashes, rows, 3)
    counts = collections.Counter(i for i, _ in want)
    assert collections.Counter(own.tolist()) == {i: max(1, n - 2) for i, n in counts.items()}


def test_steps_cut_batches_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 10 + ["y" * 100] + [None] * 3)], names=["text"])
    parts = [p.num_rows for p in common.steps(batch, most=35)]
    assert sum(parts) == 14 and max(parts[:3]) == 3


def jaccard(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=20), st.lists(st.integers(0, 9), max_size=20))
def test_probability_jaccard(a, b):
    pair = [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (collections.Counter(a), collections.Counter(b))]
    assert minhash.probability_jaccard(*pair) == pytest.approx(jaccard(a, b))


def test_signatures_estimate_it():
    rng = random.Random(3)
    a = [rng.randrange(60) for _ in range(120)]
    b = a[:80] + [rng.randrange(60) for _ in range(40)]
    rows = [(i, k, n) for i, c in enumerate((collections.Counter(a), collections.Counter(b))) for k, n in sorted(c.items())]
    sig = minhash.signatures(np.array([r[0] for r in rows]), common.mixed(np.array([r[1] for r in rows], np.uint64)), np.array([r[2] for r in rows]), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(jaccard(a, b), abs=0.05)


def make_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def near_texts(n=60, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(30, 120))] for _ in range(n // 6)]
    out = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(len(base), n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((i, " ".join(w)))
    return out


def brute_classes(rows, least=0.8):
    sh = {i: [tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))] if t and t.split() else [] for i, t in rows}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sh:
        for j in sh:
            if i < j and sh[i] and sh[j] and jaccard(sh[i], sh[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sh}


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(spark, block):
    rows = [*near_texts(), (900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "one two"), (905, "x y z a b " * 400)]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(make_docs(spark, rows), block=block).collect()}
    want = brute_classes(rows)
    assert got == {i: (c, i == c) for i, c in want.items()}


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    df = make_docs(spark, rows).withColumns({"keys": F.lit(1), "f1": F.lit(2), "class_id": F.lit(3)})
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (None, None, True)]
    # Of a repeated doc_id the least text counts, wherever it stands.
    a, b = "a b c d e f", "u v w x y z"
    for rows in ([(5, a), (5, b), (1, b), (2, a)], [(5, b), (5, a), (1, b), (2, a)]):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(spark, rows)).collect()} == {5: 2, 1: 1, 2: 2}
    assert minhash.near_duplicates(make_docs(spark, [])).count() == 0


def test_components(spark, tmp_path):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500, k) for k in range(600, 700)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in list(root))


def _lexicon(*insults):
    return toxicity.Lexicon(words=dict.fromkeys(insults, 3.0))


def test_toxicity_grammar():
    lex = toxicity.Lexicon(words={"idiot": 3.0}, prefixes={"vequ": 4.0})
    assert lex.weight("vequain") == 4.0 and lex.weight("idiots") == 0.0
    f = lambda t: toxicity.clause_score(t, lex)
    assert f("you idiot") > f("some idiot") > f("not an idiot") and f("some idiot") > f("he said idiot") and f("i will kill you") == 3.0 * 1.25 and f("kill") == 0
    # Agent, verb and victim in their orders; a verb whose object is no person threatens nobody.
    for t in ("you will be killed", "you'll be killed", "you are going to be beaten", "ich werde dich töten", "te voy a matar", "je vais te tuer", "they will kill you", "tu seras tué"):
        assert f(t) == 3.75, t
    for t in ("they burn wood", "you beat eggs and they smash potatoes", "we burn wood for you", "they killed time", "you will be fed"):
        assert f(t) == 0, t
    assert f("i will not hurt you") < f("you beat him") < f("kill them all") < f("i will kill you")
    # Scopes: a contrast ends a negation, a closing mark a quotation, and own words are not reported ones.
    assert f("not bad but an idiot") == 3.0 and f("not an idiot") == pytest.approx(0.3) and f("not a b c d idiot") == 3.0
    assert f("i told you you idiot") == 3.75 > f("she told us you idiot") and f('"a" idiot') == 3.0 > f('"an idiot"')
    assert f("an idiot you") == 3.75 and f("an idiot x y you") == 3.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(toxicity.CLASSES), max_size=25))
def test_composition_is_all_machines_side_by_side(symbols):
    machines = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.threat()]
    states, composed = [m.start for m in machines], 0
    for s in symbols:
        moves = [m.step(q, s) for m, q in zip(machines, states, strict=True)]
        states, factor = [m[0] for m in moves], math.prod(m[1] for m in moves)
        composed, f, w = toxicity.GRAMMAR[composed][toxicity.CLASSES.index(s)]
        assert f == pytest.approx(factor) and w == pytest.approx(factor * sum(m[2] for m in moves))


def _features(lex, *texts):
    return toxicity.features(pa.array(texts, pa.string()), lex, lex.heads())


def test_toxicity_reads_long_clauses_whole():
    lex = _lexicon("idiot")
    long = "skill " * 60 + "an idiot " + "word " * 150 + "you idiot " + "skill " * 70 + "i kill all of you " + "word " * 300
    alone = _features(lex, long)[0]
    total = toxicity.clause_score(long, lex)
    assert np.allclose(alone[:3], np.log1p([total, 1, total])) and total == 3 + 3 * 1.25 + 3 * 1.25
    for before in ("x" * 399, "x" * 401, "word. " * 77):
        assert np.array_equal(_features(lex, before, long)[1], alone)


def test_toxicity_does_not_depend_on_the_batch():
    rng = random.Random(21)
    lex = _lexicon("idiot", "imbécil")
    words = ["idiot", "imbécil", "you", "not", "said", "kill", "i", "word", "é", "«", '"', ".", "!", ";"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(80)]
    alone = np.array([_features(lex, t)[0] for t in texts])
    order = list(range(80))
    for size in (1, 7, 80):
        rng.shuffle(order)
        for k in range(0, 80, size):
            part = order[k : k + size]
            assert np.array_equal(_features(lex, *(texts[i] for i in part)), alone[part])


def test_toxicity_beside_other_punctuation():
    lex = _lexicon("idiot", "connard", "imbécil")
    got = _features(lex, "he is an idiot here", "¡imbécil! he", "you\u00a0idiot", "so “idiot”", "so «connard»", "a—idiot😀 he", "naïveidiot", "", "you’re 'idiot'", "1,'idiot'")
    assert np.allclose(np.expm1(got[:, 0]), [3 * 1.25, 3, 3 * 1.25, 3 * 0.6, 3 * 0.6, 3 * 1.25, 0, 0, 3.75, 3])
    for t in ("é—ß €😀٣漢x", "", "ab", "\u00a0", "e\u0301"):
        want = "".join(c if c.isalnum() or c < "\x80" else " " * len(c.encode()) for c in t)
        assert toxicity.separated(np.frombuffer(t.encode(), np.uint8)).tobytes().decode() == want


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        t, toxic = [rng.choice(words) for _ in range(rng.randrange(20, 80))], i % 5 == 0
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = "zorgu" + rng.choice("abcdefgh")
        rows.append((i, " ".join(t).replace("word7 ", "word7. ")))
        labels.append((i, int(toxic)))
    docs = make_docs(spark, [*rows, (900, None), (901, ""), (902, "zorgub " * 9000), (None, "zorgub zorguc")])
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.learn(docs, lab)).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert sum(got[i].predicted == dict(labels)[i] for i in held) >= 0.97 * len(held)
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1
    empty = toxicity.learn(docs.limit(0), lab.limit(0))
    assert toxicity.toxicity(docs.limit(0), empty).count() == 0
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), empty)
    assert kept.columns == ["doc_id", "text", "score"]


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "<|endoftext|>", "12", "…"]) for _ in range(rng.choice([0, 3, 40, 700, 3000])))) for i in range(80)]
    rows += [(900, None), (901, ""), (901, ""), (None, "x")]
    pieces = packing.pack(make_docs(spark, rows).withColumn("start", F.lit(1)).repartition(3)).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for i, text in rows[:81]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[i], key=lambda p: p.start)
        assert own[0].start == 0 and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for a, b in zip(own, own[1:], strict=False):
            assert a.start + a.length == b.start
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    seqs = collections.defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
    short = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        short += at < 1024
    assert short <= 3 and packing.pack(make_docs(spark, [])).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(8)
    for s in (3, 5, 6, 3):
        p.place((0, 0, np.zeros(s), s), s)
    assert p.counts[6] == 1 and p.counts[3] == 1  # 3 + 5 filled a window
    assert sum(sum(len(x[2]) for x in b) for b in p.flush()) == 9


def brute_base(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


_parts = st.lists(st.sampled_from(["password", "ToKen", "ſecret", "api_key", "apikey", ": ", "=", '"', " ", "é", "abcdefgh", "x", "AKIA", "ABCDEF123456", "0123456789abcdef", "\n"]), max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(_parts)
def test_base_spans(text):
    assert ",".join(f"{k}:{s}:{e}" for k, s, e in secrets.find(text) if k in secrets.BASE_KINDS) == brute_base(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdef0123", max_size=60), st.integers(2, 12), st.sampled_from([1.0, 2.0, 2.5]))
def test_entropy_windows(text, w, least):
    cover = set()
    for i in range(len(text) - w + 1):
        c = collections.Counter(text[i : i + w])
        if -sum(n / w * math.log2(n / w) for n in c.values()) >= least - 1e-9:
            cover |= set(range(i, i + w))
    got = [set(range(a, b)) for a, b in secrets.window_runs(text, w, least)]
    assert set().union(*got) == cover and sum(map(len, got)) == len(cover)


def test_secrets(spark):
    key = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8t"
    rows = [(1, f"é key {key} end"), (2, f"EXAMPLE{key}"), (3, None), (4, ""), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (None, "plain")]
    got = secrets.digest(secrets.find_secrets(make_docs(spark, rows).withColumn("spans", F.lit(1)))).collect()
    assert [r.spans for r in got[:4]] == [f"entropy_base64:6:{6 + len(key)}", "", "", ""] and got[4].n_assign == got[4].n_hex == 1
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == 6
    clean = secrets.redacted(make_docs(spark, rows)).collect()
    assert clean[0].text == "é key [REDACTED] end" and clean[2].text is None
    assert secrets.redact("abcdef", [("x", 1, 3), ("y", 2, 4)]) == "a[REDACTED]ef"


def test_secrets_suppress_parts():
    key, low = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8t", "8a40f2a4-56e2-4d0b-9ce6-6f0c37f2ab51"
    at = lambda text: [(k, text[s:e]) for k, s, e in secrets.find(text)]
    assert at(f"example/{key}") == [("entropy_base64", "/" + key)]
    assert at(f"{low}_{key}")[0][1].strip("_") == key and at(low) == [] and at(f"id-{low}") == []
    assert at("docs.org/Reference/Guide2/HowToReadTheFirstPage") == []
    blob = key * 40
    assert sum(e - s for _, s, e in secrets.find(blob + "xxxx" + blob)) >= 2 * len(blob) - 2 * secrets.WINDOW
    parts = list(secrets.searched("A1-dummy-B2"))
    assert parts == [(0, 3), (8, 11)] and list(secrets.searched("")) == []


@pytest.mark.parametrize("word", ["production", "abcdefghi", "Database", "backup2"])
@pytest.mark.parametrize("size", [24, 32])
def test_secrets_glued_to_words(word, size):
    rng = random.Random(size)
    marks = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(marks) for _ in range(size)) for _ in range(3000)]

    def found(text, low):
        """Whether the spans cover the key but for what a window at its edge leaves out."""
        return sum(max(0, min(e, low + size) - max(s, low)) for _, s, e in secrets.find(text)) >= size - 4

    alone = sum(found(k, 0) for k in keys)
    assert alone >= 0.95 * len(keys)
    for joined in (lambda k: (word + k, len(word)), lambda k: (k + word, 0), lambda k: (f"{word}_{k}", len(word) + 1)):
        assert sum(found(*joined(k)) for k in keys) >= alone - 0.01 * len(keys)


def test_equal_keys_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quality, "CELL_ROWS", 20)
    rows = [(None, 0.0)] * 900 + [(i, 0.0) for i in range(100)]
    weighted = spark.createDataFrame(rows, "doc_id long, log_weight double").withColumns({"p": F.lit(1), "part": F.lit(2), "n": F.lit(3)}).repartition(7)
    out = quality.gumbel_top_k(weighted, keep=0.6)
    assert out.columns == [*weighted.columns, "gumbel_key", "kept"]
    got = out.collect()
    assert len(got) == 1000 and sum(r.kept for r in got) == 600
    edge = min(r.gumbel_key for r in got if r.kept)
    assert all(r.kept for r in got if r.gumbel_key > edge) and not any(r.kept for r in got if r.gumbel_key < edge)


@pytest.mark.parametrize("few", [100_000, 20])
def test_quality(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "CELL_ROWS", few)
    monkeypatch.setattr(quality, "CELLS", 7)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(rng.randrange(5, 200)))) for i in range(400)]
    docs = make_docs(spark, [*rows, (900, None), (901, " "), (None, "good1 good2")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.gumbel_top_k(quality.importance(docs, labels), keep=0.6).collect()
    assert sum(r.kept for r in out) == math.ceil(0.6 * 403)
    edge = min(r.gumbel_key for r in out if r.kept)
    assert all(r.kept == (r.gumbel_key >= edge) for r in out)
    by = {r.doc_id: r for r in out}
    assert min(by[i].score for i in range(400) if i % 4) > max(by[i].score for i in range(0, 400, 4))
    # The ratio and the weights, from counts of hashed words and pairs.
    bucket = lambda t: quality.grams(pa.array([t], pa.string()), quality.BUCKETS)[0].tolist()
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        raw.update(bucket(t))
        if i is not None and i < 300 and i % 4 and zlib.crc32(str(i).encode()) % 3 != 1:
            target.update(bucket(t))
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    p = lambda k: (raw[k] + 1) / (n_raw + size)
    ratio = lambda k: math.log((target[k] + 4 * size * p(k)) / (n_target + 4 * size) / p(k))
    for i, t in texts.items():
        assert by[i].n_grams == len(bucket(t)) and (not bucket(t) or by[i].log_weight == pytest.approx(sum(map(ratio, bucket(t)))))
    assert quality.gumbel_top_k(quality.importance(docs.limit(0), labels)).count() == 0


def test_unit_vectors_of_any_size():
    got, ok = vectors._vector(pa.array([[1e200, 1e200], [1e-200, 1e-200], [3.0, 4.0], [5e-324], [0.0], [], None, [1.0, None], [float("inf")], [1.0, float("nan")]], pa.list_(pa.float64())))
    assert ok.tolist() == [True] * 4 + [False] * 6
    half = np.sqrt(0.5)
    assert [np.allclose(np.frombuffer(g, "<f8"), w) for g, w in zip(got[:4], ([half, half], [half, half], [0.6, 0.8], [1.0]), strict=True)] == [True] * 4
    sliced, _ = vectors._vector(pa.array([[9.0], [3.0, 4.0]], pa.list_(pa.float64())).slice(1))
    assert np.allclose(np.frombuffer(sliced[0], "<f8"), [0.6, 0.8])


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    x = np.r_[base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:5], base[:5] * 2, np.zeros((1, 16))]
    labels = [int(k) for k in rng.integers(0, 2, len(x))]
    rows = [(k, [float(v) for v in a], labels[k]) for k, a in enumerate(x)]
    odd = [(200, None, 1), (201, [], 1), (202, [1.0, float("nan")], 1), (203, [1.0, None], 1), (204, [float(v) for v in base[0]], None), (205, [1.0, 2.0], 1), (206, [1.0, 2.0], 1), (None, [1.0], 1)]
    df = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<double>, label int").withColumns({"unit": F.lit(1), "n": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, cell=8, block=6).collect()}
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, where=n > 0, out=np.zeros_like(x))
    near = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for _ in range(len(x)):
        comp = [min([comp[k], *(comp[j] for j in np.flatnonzero(near[k]))]) for k in range(len(x))]
    for k in range(len(x)):
        assert got[k] == (near[k].sum(), comp[k], comp[k] == k), k
    assert all(got[k] == (0, k, True) for k in (200, 201, 202, 203, 204)) and got[205][0] == 1 and got[206] == (1, 205, False) and got[None] == (0, None, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 1000), max_size=400), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_sorted_tables(counts, others):
    hashed = lambda x: common.mixed(np.array(x, np.uint64))
    keys, asked = hashed(list(counts)), hashed([*counts, *others])
    order = np.argsort(keys)
    arrays = kneserney._table("x", keys[order], np.array(list(counts.values()), np.int64)[order])
    assert kneserney._counts(arrays, "x", asked).tolist() == [counts.get(k, 0) for k in (*counts, *others)]


def test_sums_of_many_shards_are_few_rows(spark):
    rng = np.random.default_rng(1)
    rows, want = [], np.zeros(5132, np.int64)
    for _ in range(2000):
        n = np.zeros(5132, np.int64)
        n[rng.integers(0, 5132, 40)] = rng.integers(1, 100, 40)
        want += n
        rows.append(tuple(map(bytearray, kneserney._placed(n))))
    arrays = spark.createDataFrame(rows, "at binary, n binary").repartition(50)
    assert (kneserney.summed(arrays, 5132) == want).all()
    assert (kneserney.summed(arrays.limit(0), 7) == 0).all()


@pytest.mark.parametrize("sampled", [64, 1])
def test_kneser_ney(spark, monkeypatch, sampled):
    monkeypatch.setattr(kneserney, "SAMPLED", sampled)  # 1: the commonest tokens count as frequent
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["A", "b", "c d", "É", "a"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)] + [(900, None), (901, ""), (901, "a zz"), (None, "b b")]
    got = kneserney.score_held_out(make_docs(spark, rows).repartition(3)).collect()
    split = lambda t: [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    train = [split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    grams = lambda ws: list(zip(["<s>", "<s>", *ws[:-2]], ["<s>", *ws[:-1]], ws, strict=False)) if len(ws) > 1 else [("<s>", "<s>", ws[0])]
    c, three = collections.Counter(w for t in train for w in t), collections.Counter(g for t in train for g in grams(t))
    two = collections.Counter((v, w) for _, v, w in three)
    one = collections.Counter(w for _, w in two)
    hi, mid, lo = (kneserney.discounts(np.array([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)])) for x in (three, two, one))
    d = lambda ds, n: ds[min(n, 3) - 1] if n else 0.0
    total, gamma = ({}, {}), ({}, {})
    for level, (counts, ds) in enumerate(((two, mid), (three, hi))):
        for g, n in counts.items():
            total[level][g[:-1]] = total[level].get(g[:-1], 0) + n
            gamma[level][g[:-1]] = gamma[level].get(g[:-1], 0) + d(ds, n)
    rest = sum(d(lo, n) for n in one.values()) / len(two)
    p1 = lambda w: (one[w] - d(lo, one[w])) / len(two) + rest / (len(c) + 1)
    p2 = lambda v, w: (two[v, w] - d(mid, two[v, w]) + gamma[0][v,] * p1(w)) / total[0][v,] if (v,) in total[0] else p1(w)
    prob = lambda u, v, w: (three[u, v, w] - d(hi, three[u, v, w]) + gamma[1][u, v] * p2(v, w)) / total[1][u, v] if (u, v) in total[1] else p2(v, w)
    unseen = rest / (len(c) + 1)
    assert sum(prob("a", "b", w) for w in c) + gamma[1]["a", "b"] / total[1]["a", "b"] * gamma[0]["b",] / total[0]["b",] * unseen == pytest.approx(1)
    want = collections.defaultdict(list)
    for i, t in rows:
        ws = split(t)
        want[i].append((len(ws), sum(c[w] > 0 for w in ws), sum(c.values()), sum(math.log10((c[w] + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1))) for w in ws), sum(math.log10(prob(*g)) for g in grams(ws))))
    for r in got:
        assert any(tuple(r)[2:] == pytest.approx(w) for w in want[r.doc_id]), r
    assert len(got) == len(rows) and kneserney.score_held_out(make_docs(spark, [])).count() == 0


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = ["http://a.Example.COM/en/77?x#y", "https://example.com/en", "x://com/en/", "ftp://xcom/en/", "http://b.net/de/8", "http://example.net/de/8/9", "http://EXAMPLE.org/es/#/", "no scheme", None, "://", "http://a://b.com/en/", "http://example.com?/en/7", "http://xn.example.com/en/7a", "http://u@example.com:80/en/7", "h://exampleé.com/en/é\n7"]
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)] + [(None, "http://net/de/", "x")], "page_id long, url string, host string")
    got = urlfilter.judge_urls(df).collect()
    assert [tuple(r)[1:] for r in got] == [brute_verdict(u) for u in [*urls, "http://net/de/"]]
    assert urlfilter.judge_urls(df.limit(0)).count() == 0
    assert urlfilter.Trie([("block", "a.com/x/y"), ("allow", "a.com/x/")]).match("b.a.com", "/x/yz") == ("a.com/x/y", "block")


def test_subsequence():
    rng = random.Random(11)
    for _ in range(60):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 15))], [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(decontam._masks(np.array(a, np.uint64)), len(a), np.array(b, np.uint64)) == t[-1][-1]


def test_leaks(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(2000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(15, 60)))) for i in range(30)]
    rows, want = [], set()
    for d in range(150):
        w = prose(rng.randrange(5, 400))
        if d % 5 == 0:
            i, t = rng.choice(items)
            x = t.split()
            if d % 10 == 0:  # a paraphrase
                x = [rng.choice(vocab) if rng.random() < 0.2 else v for v in x]
            at = rng.randrange(len(w))
            w[at:at] = x
            want.add((d, i))
        rows.append((d, " ".join(w).upper() if d % 3 == 0 else ", ".join(w)))
    docs = make_docs(spark, [*rows, (900, None), (901, ""), rows[0]]).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*items, (77, None), (78, "?!"), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert want - {x for x in want if x[0] % 10 == 0} <= got and len(want - got) <= 1 and got <= want
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_many_short_items(spark, monkeypatch):
    rng = np.random.default_rng(14)
    vocab = np.array([f"v{i}" for i in range(3000)])
    prose = lambda n: vocab[np.minimum(rng.zipf(1.3, n) * 7 + rng.integers(0, 40, n), 2999)].tolist()
    items = [(i, " ".join(prose(int(rng.integers(8, 20))))) for i in range(2000)]
    rows, want = [], set()
    for d in range(300):
        w, taken = prose(250), rng.choice(2000, 4, replace=False)
        for at, i in zip((200, 140, 90, 30), taken.tolist(), strict=True):
            w[at:at] = items[i][1].split()
            want.add((d, i))
        rows.append((d, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.PASS_TERMS, 2000):
        monkeypatch.setattr(decontam, "PASS_TERMS", most)
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(make_docs(spark, rows), bench).collect()}
        assert want <= got


def test_lookup_of_terms_that_share_a_slot():
    terms = np.array([k << 44 | r for k in range(5) for r in range(1, 4)], np.uint64)
    tokens = np.array([0, *terms[::-1].tolist(), 9 << 44, 2 << 44 | 7], np.uint64)
    place, term = decontam.Index(terms, np.zeros(0), [], []).lookup(tokens)
    assert place.tolist() == list(range(1, 16)) and term.tolist() == list(range(15))[::-1]


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        runs = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(d), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(d, cover, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, hot):
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(90) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = noise(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            t += s[a : a + rng.randrange(10, 90)] + noise(rng.randrange(0, 20))
        texts.append(t)
    texts += [None, "", "x" * 500, texts[0], texts[0], "yz" * 90, "\0" * 90, "short"]
    ids = [*range(len(texts) - 1), 0]  # the last id comes twice, with another text
    docs = make_docs(spark, list(zip(ids, texts, strict=True))).withColumn("rid", F.lit(5)).repartition(4)
    rows, spans = suffixes.repeated_spans(docs.select("doc_id", "text"), 40, 16, hot)
    found = {r.rid: np.array([(s.start, s.end) for s in r.spans]) for r in spans.collect()}
    got = []
    for r in rows.collect():
        left, cut, runs = suffixes.remove((r.text or "").encode(), found[r.rid]) if r.rid in found else ((r.text or "").encode(), 0, 0)
        got.append((r.doc_id, len((r.text or "").encode()), cut, runs, hashlib.sha256(left).hexdigest()))
    assert sorted(got) == sorted((i, *b) for i, b in zip(ids, brute_repeats(texts, 40), strict=True))
    if hot > 1:
        out = sorted(tuple(r) for r in suffixes.remove_repeats(docs).collect())
        assert out == sorted((i, *b) for i, b in zip(ids, brute_repeats(texts, 200), strict=True))
        assert suffixes.remove_repeats(make_docs(spark, [])).count() == 0


def test_suffixes_are_dealt_out_in_bounded_arrays(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(400)) for _ in range(40)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([b"%016d" % i for i, _ in part]), pa.array([t for _, t in part])], names=["rid", "text"])
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffixes, "HELD_BYTES", 1000)
    got = list(suffixes._arrays(8, 200, 64)(iter([batch(rows[i : i + 5]) for i in range(0, 40, 5)])))
    assert len(got) > 4 and all(sum(map(len, g.column(2).to_pylist())) < 20_000 for g in got)


def test_family_merges_geometrically():
    rng = np.random.default_rng(14)
    runs, kind = [], suffixes.entry(64)
    for k in range(9):
        e = np.zeros(20, kind)
        e["suffix"] = [bytes([65 + int(x)]) * 64 + int(y).to_bytes(16, "big") for x, y in zip(rng.integers(0, 40, 20), rng.integers(0, 3, 20), strict=True)]
        e["rid"] = [b"%d-%d" % (k, i) for i in range(20)]
        e = suffixes.Family.sort(e)
        runs.append(e[np.unique(e["suffix"], return_index=True)[1]])
    family, found = suffixes.Family(), []
    for r in runs:
        found.append(family.add(r.copy()))
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((x["suffix"][:-1] < x["suffix"][1:]).all() for x in family.levels)
    n = collections.Counter(x for r in runs for x in r["suffix"].tolist())
    assert {x for f in found for x in f["suffix"].tolist()} == {k for k, v in n.items() if v > 1}
    assert len({x for f in found for x in f["rid"].tolist()} ^ {r["rid"][i] for r in runs for i in range(len(r)) if n[r["suffix"][i]] > 1}) == 0
    assert len(family.close()) == len(n)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(15)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(900)), np.uint8)
    at = np.array(sorted(rng.sample(range(890), 400)))
    n = collections.Counter(data[k : k + 8].tobytes() for k in at)
    want = [n[data[k : k + 8].tobytes()] > 1 for k in at]
    assert suffixes.equal_windows(data, at, 8).tolist() == want
    real = suffixes._windows
    monkeypatch.setattr(suffixes, "_windows", lambda d, k: real(d, k) % np.uint64(7))
    assert suffixes.equal_windows(data, at, 8).tolist() == want
