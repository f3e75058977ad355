"""Training-data operators against brute force, round trips and held-out accuracy, with the edge cases of each."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, fingerprints, language_id, licences, line_dedup, lm_scoring, near_vectors, ngram_join, packing, toxicity
from graphloom.llm.common import connected_components
from graphloom.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, line int, component int"
PATH = vocabulary_path()
ODD = [None, "", " ", "\n\n", "a", "a" * 5000, " " * 3000 + "x", "x <|endoftext|> y", "é ß\U0001f600", "word " * 4000, "the cat sat on the mat today", "the cat sat on the mat today"]


def docs(spark, texts, lang="en"):
    rows = [(k, t, lang if isinstance(lang, str) or lang is None else lang[k], "s", None if t is None else len(t), "e", k, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_bpe_equals_library(spark, library):
    got = {r["doc_id"]: r for r in bpe.bpe_encode_decode(docs(spark, ODD), PATH).collect()}
    for k, t in enumerate(ODD):
        assert list(got[k]["ids"]) == library_ids(library, t)
        assert got[k]["decoded"] == library.decode(library_ids(library, t), skip_special_tokens=False)
    assert bpe.bpe_encode_decode(docs(spark, []), PATH).count() == 0


def test_bpe_random_texts(library):
    rng = random.Random(1)
    alphabet = "abcdeE 'st12\n\t.,!é¼²ßøΣж中 ̀\U0001f600\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for enc in (bpe.encoder_for(PATH, "segment_tree"), bpe.encoder_for(PATH, "library")):
        flat, n = enc.encode(texts)
        ends = np.cumsum(n)
        for t, a, b in zip(texts, ends - n, ends):
            assert flat[a:b].tolist() == library_ids(library, t)


def test_long_and_short_words_merge_alike():
    v = bpe.Vocabulary(PATH)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"thean onring") for _ in range(rng.randrange(1, 120))) for _ in range(200)]
    flat, n = bpe.segment_tree_words(v)([w.decode() for w in words])
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [bpe.merge_long(v, w) for w in words]


def test_packing(spark, library):
    texts = ODD + ["lorem ipsum " * k for k in range(1, 400, 7)]
    rows = packing.pack_documents(docs(spark, texts), PATH, pool=16).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts)
    for k, t in enumerate(texts):
        ids = np.array(library_ids(library, t) + [0], "<u4")
        parts = sorted(by_doc[k], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in parts) == ids.tobytes() and all(r["doc_tokens"] == len(ids) for r in parts)
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))]
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))]
        assert total == 1024 or total & (total - 1) == 0
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_packing_of_a_very_long_run_of_blanks(library):
    text = " " * 1_500_000 + "x"
    flat, n = bpe.encoder_for(PATH, "library").encode([text, "a"])
    assert n.tolist()[1] == 1 and flat[: n[0]].tolist() == bpe.encoder_for(PATH, "segment_tree").encode([text])[0].tolist()


def test_a_remainder_without_partners_blocks_no_other():
    rng = random.Random(5)
    lengths = [1021, 1022, 1023] + [rng.randrange(20, 700) for _ in range(3000)]
    packer = packing.Packer(1024, 200, 0)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype="<u4"))
        assert packer.waiting < 200
    packer.flush(True)
    pieces, fill = defaultdict(list), defaultdict(int)
    for doc_id, start, length, ids, n, sequence, offset in packer.out:
        assert offset == fill[sequence] and n == lengths[doc_id]
        fill[sequence] += length
        pieces[doc_id].append((start, ids))
    for k, n in enumerate(lengths):
        assert b"".join(ids for _, ids in sorted(pieces[k])) == np.arange(n, dtype="<u4").tobytes()
    assert all(v == 1024 or v & (v - 1) == 0 for v in fill.values()) and sum(v < 1024 for v in fill.values()) <= 10
    assert sum(len(v) > 1 for v in pieces.values()) <= 60


def test_closest_fill_is_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        got = packing.closest_fill(counts, room)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room) and all(v <= counts[k] for k, v in got.items())


def shingles(t):
    w = (t or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(sets, linked):
    left = {k: k for k in sets}

    def find(x):
        while left[x] != x:
            x = left[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                left[y] = x
    return {k: find(k) for k in keys}


def test_ngram_join_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))] for _ in range(12)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    texts = list(ODD)
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w[: rng.randrange(1, len(w) + 1)]
        if rng.random() < 0.3:
            w += shared
        texts.append(" ".join(w).upper() if rng.random() < 0.1 else "  ".join(w))
    df = docs(spark, texts).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df).collect()}
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    assert got == {k: (len(sets[k]), want[k]) for k in sets}
    assert ngram_join.ngram_jaccard_join(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [4, 64])
def test_ngram_join_of_families_of_near_copies(spark, monkeypatch, hot):
    """Families of many near copies, some beyond the threshold of every other: all pairs compared in plain Python."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(14)
    vocabulary = [f"w{k}" for k in range(500)]
    passages = [[rng.choice(vocabulary) for _ in range(8)] for _ in range(6)]
    texts = []
    for size in (160, 60):
        base = [rng.choice(vocabulary) for _ in range(110)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(passages) if rng.random() < 0.25 else [rng.choice(vocabulary)]
            if k % 7 == 0:
                w = w[: rng.randrange(70, len(w))]
            texts.append(" ".join(w))
    texts += texts[:20]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs(spark, texts).repartition(3)).collect()}
    want = components({k: shingles(t) for k, t in enumerate(texts)}, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert got == want and len(set(want.values())) > 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 12))] for _ in range(25)]
    texts = list(ODD)
    for _ in range(110):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(base))
            i, how = rng.randrange(len(w)), rng.random()
            w = w[:i] + [rng.choice(vocabulary)] + w[i + 1 :] if how < 0.25 else w[:i] + w[i + 1 :] if how < 0.45 else w[:i] + [rng.choice(vocabulary)] + w[i:] if how < 0.65 else w
            lines.append(" ".join(w))
            if rng.random() < 0.1:
                lines.append("")
        texts.append("\n".join(lines))
    df = docs(spark, texts)
    order = [(k, n, line.encode().split()) for k, t in enumerate(texts) if t for n, line in enumerate(t.split("\n")) if line.encode().split()]
    near = lambda a, b: a == b or (min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) < 2 and distance(a, b) <= 1)
    want = {(k, n) for i, (k, n, w) in enumerate(order) if any(near(x, w) for _, _, x in order[:i])}
    dropped, _ = line_dedup.repeated_lines(df)
    assert set(dropped.columns) == {"doc_id", "copy", "line"}
    assert {(r["doc_id"], r["line"]) for r in dropped.collect()} == want
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        keep = [x for n, x in enumerate(lines) if (k, n) not in want]
        if any(x.split() for x in lines) and not any(x.split() for x in keep):
            assert k not in got
        else:
            assert got[k]["text"] == (None if t is None else "\n".join(keep))
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_rows_of_one_id(spark):
    """Three texts under one id, two of them equal, with near lines among them and in a later document."""
    line = "a b c d e f g h i"
    rows = [(1, f"x\n\n{line}"), (1, line[:-1] + "j\nown words"), (1, line[:-1] + "j\nown words"), (2, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert len(got) == 3 and [g[0] for g in got] == [1, 1, 1]
    near = [t for _, t in got if line[:-2] in t]
    assert near in ([f"x\n\n{line}"], [line[:-1] + "j\nown words"] * 2) and all("own words" in t or t.startswith("x") for _, t in got)


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    clean, bad = [f"c{k}" for k in range(400)], ["slur", "insult", "scum", "fool"]
    texts, marks = [], []
    for k in range(1200):
        toxic = k % 6 == 0
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        marks.append((k, int(toxic)))
    texts += ODD
    labels = spark.createDataFrame(marks + [(5, None), (0, 0), (None, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.predict_toxicity(docs(spark, texts), labels).collect()}
    held = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(out) == len(texts) and {k for k in out if out[k]["held_out"] and k < 1200} == set(held)
    assert np.mean([out[k]["predicted"] == dict(marks)[k] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    none = toxicity.predict_toxicity(docs(spark, ODD), labels.where("false")).collect()
    assert len(none) == len(ODD) and all(r["predicted"] == 0 for r in none)


def test_language_held_out(spark):
    rng = random.Random(7)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "er", "ung"], "cc": ["ción", "ña", "ell"]}
    texts, langs = [], []
    for k in range(300):
        lang = sorted(syllables)[k % 3]
        texts.append(" ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))))
        langs.append(lang)
    texts += [None, "", "123 !?", "²", "ka" * 4000]
    langs += [None] * 5
    out = {r["doc_id"]: r for r in language_id.identify_language(docs(spark, texts, langs)).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k]["lang_pred"] == langs[k] for k in held]) > 0.95
    assert [out[k]["lang_pred"] for k in range(300, 304)] == ["und"] * 4 and out[304]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in language_id.identify_language(docs(spark, ["abc"], None)).collect()} == {"und"}


def test_gru_gradients():
    net = language_id.Network(3)
    x, lens = language_id.padded([w.encode() for w in ("hello", "wörld", "ab", "abcdefghijklmnopqrstuvwxyzabc")])
    y = np.arange(len(lens)) % 3

    def loss():
        part = x[:, : int(lens.max())]
        p, *_ = net.positions(part, lens)
        mask = np.arange(part.shape[1])[:, None] < lens[None]
        return -(np.log(p[:, np.arange(len(y)), y]) * mask).sum() / mask.sum()

    for p, g in zip(net.params(), net.step(x, lens, y)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert g[i] == pytest.approx((up - down) / 2e-2, rel=0.02)


def test_words_of_any_length_are_read_whole():
    """Means of position probabilities, batched by length, equal those of each word alone."""
    net, rng = language_id.Network(3), random.Random(15)
    parts = ["".join(rng.choice("abé1.ß") for _ in range(n)).encode() for n in [1, 2, 3, 400, 7, 20_000, 5, 60]]
    got = net.pooled(parts)
    for k, w in enumerate(parts):
        x, lens = language_id.padded([w])
        p, *_ = net.positions(x, lens)
        assert len(p) == len(w) + 1 and got[k] == pytest.approx(p.sum((0, 1)), rel=1e-3)


def test_fingerprints(spark):
    rng = random.Random(8)
    vocabulary = [f"t{k}" for k in range(3000)]
    texts = ODD + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    texts[60] = texts[50]
    df = docs(spark, texts).repartition(5)
    rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(df).collect()}
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        r = rows[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) or t != e
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == e:
            assert r["near_edited"] == 1
    assert rows[60]["fingerprint"] == rows[50]["fingerprint"] and rows[10]["fingerprint"] == rows[11]["fingerprint"]
    big = [r for k, r in rows.items() if k >= 12]
    assert np.mean([r["near_edited"] for r in big]) > 0.3 > np.mean([r["near_next"] for r in big]) + 0.15
    assert fingerprints.document_fingerprints(docs(spark, [])).count() == 0
    assert [r["near_next"] for r in fingerprints.document_fingerprints(docs(spark, ["only one"])).collect()] == [1.0]
    plan = fingerprints.document_fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_a_large_group_of_near_copies(spark):
    """A third of all rows are copies of one text, exact, with 1 % and with 5 % of the words changed."""
    rng = random.Random(31)
    vocabulary = [f"t{k}" for k in range(3000)]
    first = [rng.choice(vocabulary) for _ in range(300)]
    changed = lambda share: " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in first)
    for share, near in ((0, 1.0), (0.01, 0.7), (0.05, 0.3)):
        texts = [changed(share) for _ in range(100)] + [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(200)]
        rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs(spark, texts)).collect()}
        assert np.mean([rows[k]["near_next"] for k in range(99)]) >= near
        assert np.mean([rows[k]["near_edited"] for k in range(99)]) >= min(near, 0.5)
        assert np.mean([rows[k]["near_next"] for k in range(100, 299)]) < 0.15


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for label in (0, 1):
        for size in (1, 2, 40, 3, 1, 1, 200 if label else 5):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((k, (centre + 0.035 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(4)]
    k += 4
    odd = [None, [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [1.0] * 15 + [float("inf")], []]
    rows += [(k + i, v, 0) for i, v in enumerate(odd)] + [(k + 6, rows[0][1], None), (k + 7, [1.0, 2.0], 0), (k + 8, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df).collect()}

    def unit(v):
        x = np.array([np.nan if c is None else c for c in v or []], float)
        return x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None

    vec = {i: (label, unit(v)) for i, v, label in rows}
    near = lambda a, b: a[0] is not None and a[0] == b[0] and a[1] is not None and b[1] is not None and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98
    comp = components(vec, near)
    links = {i: sum(near(vec[i], vec[j]) for j in vec if j != i) for i in vec}
    assert len(got) == len(rows)
    assert {i: got[i]["component_id"] for i in vec} == comp
    assert {i: got[i]["n_links"] for i in vec} == links
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_no_connection_is_lost_below_the_floors():
    """Two groups with one link across, where every row's list is full of nearer ones; k as in a local join."""
    ids = np.array([10, 11, 12, 20, 21, 22])
    angle = np.array([0.0, 0.001, 0.002, 0.15, 0.151, 0.152])
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    floor = np.full(6, 0.9999)
    u, v, s = near_vectors.offers(ids, x, 10, 0.98, floor)
    assert all(c == pytest.approx(x[ids == a][0] @ x[ids == b][0]) for a, b, c in zip(u, v, s))
    reach = {10}
    for _ in ids:
        reach |= {b for a, b in [*zip(u.tolist(), v.tolist()), *zip(v.tolist(), u.tolist())] if a in reach}
    assert reach == set(ids.tolist())


def test_lm_scoring(spark):
    rng = random.Random(10)
    good, rest = [f"g{k}" for k in range(30)], [f"r{k}" for k in range(30)]
    texts = [" ".join(rng.choice(good if k % 3 == 0 else rest) for _ in range(50)) for k in range(90)] + ODD
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(0, 1), (None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs(spark, texts), labels).collect()}
    assert len(out) == len(texts)
    assert max(out[k]["score"] for k in range(60, 90) if k % 3 == 0) < min(out[k]["score"] for k in range(60, 90) if k % 3)
    assert out[90]["n_tokens"] == 0 and out[90]["score"] == 0
    assert all(r["score"] == pytest.approx(r["target_loss"] - r["background_loss"]) for r in out.values())
    same = lm_scoring.cross_entropy_difference(docs(spark, texts), labels.where("false")).collect()
    assert all(abs(r["score"]) < 1e-9 for r in same)
    assert lm_scoring.cross_entropy_difference(docs(spark, []), labels).count() == 0


def test_lm_scoring_counts_every_ngram(spark):
    """Against counters in plain Python, on more than 65,536 words, over many blocks and ranges."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(70_000)]
    texts = [" ".join(words[(300 * k + j) % 70_000] for j in range(300)) for k in range(400)] + [" ".join(rng.choice(words[:50]) for _ in range(80)) for _ in range(40)] + [None, "", "alone"]
    good = set(range(0, len(texts), 3))
    uni, pair = ({True: defaultdict(int), False: defaultdict(int)} for _ in range(2))
    for k, t in enumerate(texts):
        w = (t or "").split()
        for a in w:
            uni[k in good][a] += 1
        for a in zip(w, w[1:]):
            pair[k in good][a] += 1
    n, m, v = sum(uni[True].values()), sum(uni[False].values()), len({*uni[True], *uni[False]})

    def loss(k, side, scale):
        w, total, inside = (texts[k] or "").split(), 0.0, (k in good) == side
        own = lambda of, a: of.count(a) if inside else 0
        two = list(zip(w, w[1:]))
        for i, a in enumerate(w):
            p = ((uni[side][a] - own(w, a)) * scale + 1) / (((n if side else m) - len(w) * inside) * scale + v)
            if i:
                p = 0.5 * p + 0.5 * min(1, (pair[side][two[i - 1]] - own(two, two[i - 1])) * scale / max(1, (uni[side][w[i - 1]] - own(w, w[i - 1])) * scale))
            total -= np.log(p)
        return total / max(1, len(w))

    labels = spark.createDataFrame([(k, int(k in good)) for k in range(len(texts))], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs(spark, texts), labels).collect()}
    for k, t in enumerate(texts):
        assert (out[k]["target_loss"], out[k]["background_loss"]) == pytest.approx((loss(k, True, 1.0), loss(k, False, n / m)), abs=1e-9)
    cut = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(docs(spark, texts), labels, block=5000).collect()}
    assert cut == pytest.approx({k: r["score"] for k, r in out.items()}, abs=1e-9)


def test_licences(spark):
    rng = random.Random(11)
    prose = lambda: " ".join("".join(rng.choice(["ka", "lo", "the", "mi", "ren"]) for _ in range(3)) for _ in range(rng.randrange(4, 40)))
    texts = [prose() + "\n" + prose() for _ in range(60)]
    marks = {}
    for k, family in enumerate(licences.TEMPLATES):
        texts[k] += "\n" + licences.TEMPLATES[family][0]
        marks[k] = family
    texts += ODD
    found = licences.scan_licences(docs(spark, texts)).where("confirmed").collect()
    assert {r["doc_id"]: r["family"] for r in found} == marks and all(r["line"] == 2 for r in found)
    assert licences.scan_licences(docs(spark, [])).count() == 0


def test_wrapped_licences(spark):
    """Full wordings wrapped at 60 columns, between paragraphs of prose: found as one paragraph of their family."""
    import textwrap

    rng = random.Random(16)
    prose = lambda: " ".join("".join(rng.choice(["ka", "lo", "the", "mi", "ren"]) for _ in range(3)) for _ in range(rng.randrange(4, 40)))
    long = {f: max((t for t in ts if ". " not in t and ";" not in t), key=len) for f, ts in licences.TEMPLATES.items()}
    texts = [prose() + ".\n\n" + prose() for _ in range(60)]
    for k, f in enumerate(long):
        texts[k] = prose() + ".\n\n" + "\n".join(textwrap.wrap(long[f], 60)) + "\n\n" + texts[k]
    found = {r["doc_id"]: r for r in licences.scan_licences(docs(spark, texts)).where("confirmed").collect()}
    assert {k: r["family"] for k, r in found.items()} == dict(enumerate(long))
    assert all(found[k]["line"] == 2 and found[k]["lines"] == len(textwrap.wrap(t, 60)) for k, t in enumerate(long.values()))
    everything = licences.scan_licences(docs(spark, texts[:3]), unknown=True).collect()
    assert sum(r["family"] == "unknown" for r in everything) >= 6


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    left = {x: x for e in edges for x in e}

    def find(x):
        while left[x] != x:
            x = left[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        left[y] = x
    assert got == {x: find(x) for x in left}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """Rejects of each stage as plain Python finds them: no letters, toxic words, lines seen before, near copies; then every id in one piece."""
    import corpus_pipeline

    rng = random.Random(13)
    words, bad = [f"w{k}" for k in range(200)], ["scum", "slur", "fool"]
    lines = lambda n: [" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)]
    texts = ["\n".join(lines(3)) for _ in range(300)]
    for k in range(100, 300, 2):
        w = texts[k].split(" ")
        for _ in range(6):
            w.insert(rng.randrange(1, len(w)), rng.choice(bad))
        texts[k] = " ".join(w)
    toxic = set(range(100, 300, 2))
    texts[7] = None
    texts[9] = "123 456"
    texts[8] = texts[3]
    texts[11] = texts[11] + "\n" + texts[5].split("\n")[1]
    first = [rng.choice(words) for _ in range(120)]
    texts[20], texts[21] = " ".join(first), " ".join([*first[:50], "new", "pair", *first[52:]])
    df = docs(spark, texts)
    df.select("*", F.lit(3).alias("bucket"), F.lit("x").alias("whole")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = at.columns, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r for r in at.collect()})
        if name != "packing":
            assert at.columns == columns
    kept = set(range(300)) - {7, 9}
    assert set(seen[0]) == kept
    kept -= toxic
    assert set(seen[1]) == kept
    kept -= {8}
    assert set(seen[2]) == kept
    assert {k: seen[2][k]["text"] for k in kept} == {k: texts[k] if k != 11 else texts[11].rsplit("\n", 1)[0] for k in kept}
    sets = {k: shingles(seen[2][k]["text"]) for k in kept}
    comp = components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    kept = {k for k in kept if comp[k] == k}
    assert set(seen[3]) == kept and 21 not in kept and 20 in kept
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append(r)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    assert set(pieces) == kept
    for k, rows in pieces.items():
        ids = np.array(library_ids(library, seen[3][k]["text"]) + [0], "<u4")
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
        assert sum(r["length"] for r in rows) == len(ids)
    empty = tmp_path / "none"
    df.where("false").write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
