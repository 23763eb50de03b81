import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from ledgerspark.llm import align, language, whitening

from .edge import BASE, LONG, ROWS, empty, table


def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# token alignment


def brute_align(rows):
    """The contract read token by token, with whole texts given to both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = files()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    found, count = [], Counter()
    for _, text in rows:
        whole = f" {text or ''}".encode()
        x = a.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx, by = [bytes(signs[c] for c in a.id_to_token(i)) for i in x], [b_bytes(i) for i in y]
        if not text or b"".join(bx) != whole or b"".join(by) != whole:
            found.append(None)
            continue
        ex, ey = ends(bx), ends(by)
        common = sorted(set(ex) & set(ey))
        groups = [("".join(f"{i}," for i, e in zip(x, ex) if p < e <= q)[:-1] + "|" + "".join(f"{i}," for i, e in zip(y, ey) if p < e <= q)[:-1]) for p, q in zip([0, *common], common)]
        links = [(x[ex.index(c)], y[ey.index(c)]) for c in common]
        count.update(links)
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, i), n in count.items():
        best[i] = max(best[i], n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for (i, _), f in zip(rows, found))


SIGNS = ["foo", "Bar", "été", "1234", "你好", "\U0001f600", "<s>", "<|endoftext|>", "</s>", "it's", "▁", "!!", "\r", "\x1c", "\x85", " ", "　", "\t", "\n", "\n\n", " ", "  ", "   ", "$x=3;", "\x00", "�", ");", "á"]


def test_align_equals_brute_force(spark):
    rnd = random.Random(4)
    mixed = [(100 + k, "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 40)))) for k in range(150)]
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in ROWS]  # the brute force is quadratic
    rows = short + mixed
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = align.align(table(spark, rows), *files())
    assert got.columns == cols
    assert Counter(tuple(r) for r in got.collect()) == brute_align(rows)


def test_align_long_text_and_parts(spark, monkeypatch):
    t = align.tokenizers(*files())
    assert t.in_parts
    texts = [LONG, BASE, "x" * 3000]
    want = [(t.a.encode(f" {x}", add_special_tokens=False).ids, t.b.encode(x)) for x in texts]
    monkeypatch.setattr(align, "KEPT", 1)  # a generation ends each time
    for _ in range(3):
        assert [(a.tolist(), b.tolist()) for a, b in t.encode(texts)] == want
        assert not t.known and not t.odd and all(len(p) <= align.KEPT_LENGTH for p in t.known.old)
    monkeypatch.setattr(t, "in_parts", False)  # whole texts give the same ids
    assert [(a.tolist(), b.tolist()) for a, b in t.encode(texts)] == want


def test_align_groups(spark):
    t = align.tokenizers(*files())
    for r in align.groups(table(spark), *files()).collect():
        if r.groups is None:
            assert r.a_ids is None and r.b_ids is None
            continue
        a, b = 0, 0
        for g in r.groups:
            assert (g.a_first, g.b_first) == (a, b)
            a, b = g.a_last + 1, g.b_last + 1
            assert b"".join(t.a_bytes[i] for i in r.a_ids[g.a_first : a]) == b"".join(t.b_bytes[i] for i in r.b_ids[g.b_first : b])
        assert (a, b) == (len(r.a_ids), len(r.b_ids))


def test_align_empty(spark):
    assert align.align(empty(spark), *files()).count() == 0
    assert align.groups(empty(spark), *files()).count() == 0
    assert {tuple(r)[1:] for r in align.align(table(spark, [(1, None), (None, "")]), *files()).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_gallop_equals_search():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        among = np.unique(rnd.integers(0, 500, rnd.integers(1, 200)))
        wanted = np.unique(rnd.integers(-5, 505, rnd.integers(1, 60)))
        near = rnd.integers(0, len(among), len(wanted))
        assert np.array_equal(align.gallop(wanted, among, near), np.searchsorted(among, wanted))


def test_linkable_pairs_hold_every_link(spark):
    t = align.tokenizers(*files())
    assert np.all(np.diff(t.pairs) > 0) and len(t.pairs) < 600_000
    for code in t.pairs[:: len(t.pairs) // 1000]:
        a, b = t.a_bytes[code // len(t.b_bytes)], t.b_bytes[code % len(t.b_bytes)]
        assert a.endswith(b) or b.endswith(a)


# whitening


EMBEDDINGS = "vec_id long, embedding array<float>, label int, key string, v string, x string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", "v", "x", "c") for i, v in rows], EMBEDDINGS).repartition(3)


def brute_whiten(rows):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = Counter(len(x) for _, x in kept).most_common(1)[0][0]
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return kept, n, s, e[::-1], u[:, ::-1], sum(v[i, i] for i in range(d))


def test_whiten_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.gauss(0, 0.2 * (j + 1)) for j in range(6)]) for k in range(120)]
    rows += rows[:30] + [(5, rows[7][1])] * 40 + [(200, None), (201, []), (202, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [0.5] * 5), (None, rows[0][1])]
    kept, n, s, e, u, trace = brute_whiten(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in kept for c in range(1, 5))
    far = Counter((i, sum((n * c - t) ** 2 for c, t in zip(x, s))) for i, x in kept)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == far and all(str(r.deviation) == r.deviation_text for r in got)
    want = defaultdict(set)
    for i, x in kept:
        for c in range(4):
            want[i, c + 1].add(round(abs(float((np.array(x) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c]))), 8))
    for r in got:
        assert any(math.isclose(abs(r.whitened), w, abs_tol=1e-7) for w in want[r.vec_id, r.component])
        assert r.n == n and math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-9
    signs = {i: x for i, x in kept}
    for c in range(1, 5):  # one sign for all rows
        dot = [r.whitened * float((np.array(signs[r.vec_id]) - np.array(s) / n) @ u[:, c - 1]) for r in got if r.component == c and r.vec_id not in (5, None)]
        assert all(x >= -1e-9 for x in dot) or all(x <= 1e-9 for x in dot)


def test_scatter_is_exact(monkeypatch):
    rnd = random.Random(3)
    for width in (2, 9, 40, 62):
        x = np.array([[rnd.randint(-(1 << width), 1 << width), rnd.randint(0, 3), 7, -(1 << width)] for _ in range(150)], np.int64)
        total, cross = whitening.scatter(x)
        own = [[int(c) for c in row] for row in x]
        assert list(total) == [sum(c) for c in zip(*own)]
        assert cross.tolist() == [[sum(r[i] * r[j] for r in own) for j in range(4)] for i in range(4)]
    for value in (0, 1, -1, 1 << 30, -(1 << 30), 1 << 200, -(1 << 200) - 5, 123456789012345678901234567890):
        assert sum(part << (whitening.LIMB * k) for k, part in enumerate(whitening._limbs(value))) == value


def test_whiten_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 3)).collect()
    assert len(same) == 6 and all(r.n == 1 and r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k]) for k in range(5)])).collect()  # rank 1: the second component has no variance
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    huge = whitening.whiten(vectors(spark, [(k, [1e30 * (k - 1), 1e15 * k]) for k in range(3)])).collect()
    assert all(r.deviation is None and int(r.deviation_text) > 1 << 63 for r in huge if r.vec_id != 1)


# language identification


def brute_language(rows):
    """Counts with dictionaries, and the mixture of every subset of languages by exhaustive search."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None and text is not None:
            counts[lang].update(language.slots(text).tolist())
    languages = sorted(counts)
    p = {x: {s: (n + language.SMOOTH) / (counts[x].total() + language.SMOOTH * language.SLOTS) for s, n in counts[x].items()} for x in languages}
    rest = {x: language.SMOOTH / (counts[x].total() + language.SMOOTH * language.SLOTS) for x in languages}
    return languages, lambda x, s: p[x].get(s, rest[x])


EN = "the quick brown fox jumps over the lazy dog and then it runs through the whole wide field with another friend of the house"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er durch das ganze weite feld mit einem anderen freund des hauses"
FR = "le rapide renard brun saute par dessus le chien paresseux et puis il court à travers tout le vaste champ avec un autre ami de la maison"


def language_rows():
    rnd = random.Random(6)
    rows = []
    for k in range(240):
        lang, base = [("en", EN), ("de", DE), ("fr", FR)][k % 3]
        words = base.split()
        rows.append((k, " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))), lang))
    mixed = " ".join(rnd.choice(EN.split()) for _ in range(60)) + " " + " ".join(rnd.choice(FR.split()) for _ in range(40))
    return rows + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, mixed, "en"), (1003, mixed, "en"), (None, DE, "de"), (1005, "q" * 50_000, None), (1006, LONG, None), (1007, FR, None)]


def language_table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 0, "l", "g", "m") for i, t, x in rows], "doc_id long, text string, lang string, source string, slot int, language string, grams string, mixture string").repartition(4)


def test_language_counts_and_mixture(spark):
    rows = language_rows()
    docs = language_table(spark, rows)
    model = language.fit(docs)
    languages, p = brute_language(rows)
    assert model.languages == languages
    for s in {*language.slots(EN).tolist(), *language.slots(DE).tolist(), 17}:
        for k, x in enumerate(languages):
            assert math.isclose(model.likelihood[k, s], p(x, s), rel_tol=1e-5)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows[:240]) >= 238
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1007)] == ["und", "und", "und", "de", "fr"] and got[1000].score == 0
    found = got[1003]
    assert found.lang_pred == "en" and {x.language for x in found.mixture} == {"en", "fr"} and 0.5 < found.score < 0.75
    assert all(0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)) for r in got.values())
    for i, text, _ in rows[:30]:  # the chosen shares are as likely as any on a grid of the same languages
        own = np.unique(language.slots(text), return_counts=True)
        parts = got[i].mixture
        level = sum(n * math.log(sum(x.share * p(x.language, s) for x in parts)) for s, n in zip(*own))
        for a in range(0, 101, 5):
            grid = [a / 100, 1 - a / 100] if len(parts) == 2 else [1.0] * len(parts)
            if len(parts) <= 2:
                assert level >= sum(n * math.log(max(1e-300, sum(g * p(x.language, s) for g, x in zip(grid, parts)))) for s, n in zip(*own)) - 0.5


def test_language_without_rows_or_labels(spark):
    assert language.fit(language_table(spark, [])) is None
    assert language.identify(language_table(spark, []), None).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(language_table(spark, [(1, "abc", None)]), language.fit(language_table(spark, [(1, "abc", None)]))).collect()} == {("und", 0.0)}


def test_language_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "AT_ONCE", 2)  # a task gives up its counts when it meets a third language
    rows = language_rows()
    one, other = language.fit(language_table(spark, rows)), brute_language(rows)
    s = language.slots("the house")[0]
    assert all(math.isclose(one.likelihood[k, s], other[1](x, s), rel_tol=1e-5) for k, x in enumerate(one.languages))


@pytest.mark.parametrize("text,has", [("1 2 3", False), ("你", True), ("½ ²", False), ("a", True)])
def test_language_letters(text, has):
    model = language.Model(["xx"], np.full((1, language.SLOTS), 1 / language.SLOTS, np.float32))
    assert bool(language.mixture(text, model)) == has == bool(regex.search(r"\p{L}", text))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), F.col("doc_id") == F.col("id")).filter("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.97
