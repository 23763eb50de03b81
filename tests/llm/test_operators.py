import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, common, decontaminate, exact_dedup, licenses, near_dedup, pii, quality, sharding, substring_dedup, toxicity
from ledgerspark.llm.queries import vocabulary_file

from .edge import BASE, LONG, ROWS, empty, table


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        done = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and not done
            done |= kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("share", [1000, 1])
def test_exact_groups(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)  # with 1 no group is hot, with 1000 all of a small table are
    got = rows_of(exact_dedup.exact_groups(table(spark)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(ROWS)
    kept = exact_dedup.keep_exact(table(spark))
    assert kept.columns == table(spark).columns
    assert kept.count() == len({t or "" for _, t in ROWS})


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.keep_exact(empty(spark)).count() == 0


def test_colliding_digests_stay_apart(spark):
    rows = [(1, "abc"), (1, "abd"), (2, "abc"), (None, "abc"), (None, "abd"), (3, None), (4, LONG), (5, LONG[:-1] + "?"), (1, "abd")]
    got = exact_dedup.exact_groups(table(spark, rows), digest=lambda piece: b"same")
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_chunks_cover_and_follow_content():
    data = random.Random(1).randbytes(60_000)
    parts = exact_dedup.chunks(data)
    assert b"".join(p for _, p in parts) == data and len(parts) > 10
    moved = exact_dedup.chunks(b"0123456789" * 40 + data)
    assert len({d for d, _ in parts} & {d for d, _ in moved}) > len(parts) * 0.7


# near dedup


def brute_near(rows):
    """Smallest doc_id reachable of every row: rows of one doc_id that have words are one document."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] or 100 * n >= 75 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
            elif sets[a] and sets[b] and rows[a][0] is not None and rows[a][0] == rows[b][0]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least[find(k)] if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def changed_copies(base, first_id, copies, most, seed):
    """Copies of a text with up to `most` words changed: many link by way of others only, some with none."""
    rnd = random.Random(seed)
    out = []
    for k in range(copies):
        w = list(base)
        for j in rnd.sample(range(len(base)), rnd.randint(0, most)):
            w[j] = "new" + str(rnd.randint(0, 99))
        out.append((first_id + k, " ".join(w)))
    return out


@pytest.mark.parametrize("copies,side", [(25, 512), (160, 7)])
def test_near_groups(spark, monkeypatch, copies, side):
    monkeypatch.setattr(near_dedup, "SIDE", side)  # small tiles, so that one star needs many
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    monkeypatch.setattr(common, "SMALL_GROUP", 5)
    rnd = random.Random(3)
    base = [str(rnd.randint(0, 9999)) for _ in range(150)]
    rows = [(99, " ".join(base))] + changed_copies(base, 101, copies, 9, seed=3) + [(100, None)] * 3 + ROWS
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows)
    if copies > 25:
        return
    kept = near_dedup.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    gone = {i for i, _, c in brute_near(rows) if i is not None and i != c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in gone)


def test_near_edges(spark):
    out = near_dedup.near_groups(table(spark)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    assert {r.n_shingles for r in out if r.doc_id in (1, 2, 4)} == {0}
    assert near_dedup.near_groups(empty(spark)).count() == 0


def test_registers_merge_and_estimate():
    import numpy as np

    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(both)).all()
    near = np.concatenate([a[:2500], b[:500]])
    j = near_dedup.likely_similarity(near_dedup.registers(a)[None], near_dedup.registers(near)[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 2500 / 3500) < 0.15


# decontamination

ITEMS = [(1, " ".join(BASE.split()[10:40])), (2, "Das ist ein"), (3, None), (4, ""), (None, BASE), (5, "one"), (5, "two words"), (6, " ".join(LONG.split()[777:795]))]


def brute_contamination(rows, items, span=13):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(span, len(w))
        for k in range(len(w) - n + 1):
            wins[n, tuple(w[k : k + n])].add(i)
    out = Counter()
    for d, t in rows:
        w = words(t)
        hit, ids = set(), set()
        for n in {k for k, _ in wins}:
            for k in range(len(w) - n + 1):
                found = wins.get((n, tuple(w[k : k + n])))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= found
        names = ",".join(sorted(map(str, ids)))
        out[d, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("most", [1 << 25, 0])
def test_contamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    monkeypatch.setattr(common, "SMALL_GROUP", 1)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, window string")
    got = rows_of(decontaminate.contamination(table(spark), items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_contamination(ROWS, ITEMS)
    kept = decontaminate.keep_clean(table(spark), items)
    assert kept.columns == table(spark).columns
    assert kept.count() == sum(n for k, n in got.items() if not k[-1])


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty(spark), none).count() == 0
    assert decontaminate.contamination(table(spark), none).filter("n_hit > 0 OR contaminated").count() == 0


# licences


def test_licenses(spark):
    rows = ROWS + [(20, "Licensed under CC-BY 4.0. All rights\nreserved; GNU General Public License."), (21, "cc by cc by"), (22, "permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and associated documentation files to deal in the software without restriction")]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert (by[20].n_base, by[20].first_word, by[20].last_word, by[20].base_labels) == (3, 2, 10, "cc-by,gpl,reserved")
    assert (by[21].n_base, by[21].first_word, by[21].last_word) == (2, 0, 2)
    assert by[22].labels == "mit" and by[22].n_base == 0 and by[22].first_word is None
    phrases = {p: tuple(p.split()) for p in licenses.BASE}
    want = Counter()
    for d, t in rows:
        w = words(t)
        want[d, len(w), sum(tuple(w[k : k + len(p)]) == p for p in phrases.values() for k in range(len(w)))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base) for r in got) == want
    assert licenses.scan(empty(spark)).count() == 0


def brute_licenses(text):
    """Labels and score by the longest ascending chain of votes of each span, every template and diagonal by itself."""
    w = words(text)
    labels, score = set(), 0.0
    for _, label, base, k, template in licenses.ALL:
        t = template.split()
        n = len(t) - k + 1
        votes = [(p, q) for p in range(len(w) - k + 1) for q in range(n) if w[p : p + k] == t[q : q + k]]
        for start in {p - q for p, q in votes}:
            near = sorted((p, -q) for p, q in votes if start <= p - q <= start + (0 if base else licenses.GAP))
            tails = []  # by patience: the least last place of chains of each length
            for _, minus in near:
                at = bisect.bisect_left(tails, -minus)
                tails[at : at + 1] = [-minus]
            share = len(tails) / n
            if share >= (1 if base else licenses.SHARE):
                labels.add(label)
            if share == 1 or not base:
                score = max(score, share)
    return ",".join(sorted(labels)), round(score, 9)


def test_licenses_own_labels(spark):
    rnd = random.Random(6)
    rows = [(1, "by nc 4 cc by nc under cc by licensed under cc"), (2, "licensed under cc by nc 4 0"), (3, "licensed under the cc by nc 4 0"), (4, None)]
    for k in range(60):  # copies with words put in, left out, changed or moved
        t = rnd.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(t))
            t = rnd.choice([t[:i] + ["x"] + t[i:], t[:i] + t[i + 1 :] or t, t[i:] + t[:i], t[:i] + ["y"] + t[i + 1 :], t + t[:i]])
        rows.append((10 + k, " ".join(["Some", "words"] * rnd.randint(0, 2) + t)))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(table(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == brute_licenses(t), i
    assert got[1][0] == "cc-by" and "cc-by-nc" in got[2][0]


# BPE


def test_bpe_equals_tiktoken(spark):
    import numpy as np
    import tiktoken

    path, pattern = vocabulary_file()
    v = bpe.vocabulary(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    got = rows_of(bpe.encode(table(spark), path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = Counter()
    for d, t in ROWS:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(table(spark), path, pattern), path, pattern)
    assert rows_of(back, "doc_id", "text") == Counter((d, t or "") for d, t in ROWS)
    assert bpe.encode(empty(spark), path, pattern).count() == 0
    rnd = random.Random(2)
    for _ in range(400):
        text = "".join(rnd.choice(rnd.choice(["ab", "the ", "aàé", "0123", "!?", "漢字か"])) for _ in range(rnd.randint(0, 300)))
        assert v.encode(text) == np.array(enc.encode_ordinary(text), "<u4").tobytes()
        data = text.encode()
        assert v.decode(v.tree(data)) == data


# PII


def test_pii_formats_and_links(spark):
    text = "Card 4539578763621486 and 1234567890123456, call +1 (212) 555-0123; born 1980-02-29, not 1981-02-29. Host 10.0.0.255 or 300.1.1.1, ssn 078-05-1120, mail Jane.Doe@mail.example.com."
    rows = ROWS + [(30, text), (31, "again 4539578763621486 on 1980-02-29 from 10.0.0.255")]
    out = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "key").collect()}
    a, b = out[30], out[31]
    assert a.kinds == "card,date,email,ip,phone,ssn" and a.n_replaced == 6
    for kept in ("1234567890123456", "1981-02-29", "300.1.1.1"):
        assert kept in a.text
    for gone in ("4539578763621486", "555-0123", "1980-02-29", "10.0.0.255", "078-05-1120", "Jane.Doe"):
        assert gone not in a.text
    card = re.search(r"Card (\d{16})", a.text)[1]
    digits = [int(c) for c in card][::-1]
    assert sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) and (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert card in b.text and re.search(r"born (\S+),", a.text)[1] in b.text and re.search(r"Host (\S+) or", a.text)[1] in b.text
    assert out[1].text is None and out[2].text == "" and out[8].text == LONG
    assert pii.pseudonymise(empty(spark), "key").count() == 0


def test_pii_spellings(spark):
    """Every spelling is replaced, keeps its signs, and equal values get equal digits."""
    same = {
        "phone": ["+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "(555)123-4567", "+1-555-123-4567", "+1 555 123 4567", "+15551234567", "1-555-123-4567", "555.123.4567", "555 123 4567"],
        "abroad": ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (0)20 7946 0958", "+44 (20) 7946 0958"],
        "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111.1111.1111.1111"],
        "amex": ["378282246310005", "3782 822463 10005", "3782-822463-10005"],
        "date": ["2024-01-15", "2024-01-15T10:00", "2024/01/15", "2024.01.15", "15/01/2024", "01/15/2024", "15.01.2024", "1/15/2024"],
        "email": ["müller@x.de", "MÜLLER@x.de"],
    }
    rows = [(i, f"Before {t} after.") for i, t in enumerate(x for k in same.values() for x in k)]
    out = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "key").collect()}
    new, i = {}, 0
    for kind, spellings in same.items():
        for t in spellings:
            got = re.fullmatch(r"Before (.*) after\.", out[i].text)[1]
            assert out[i].n_replaced == 1 and out[i].kinds == {"abroad": "phone", "amex": "card"}.get(kind, kind), (t, out[i])
            new[t], i = got, i + 1
            if kind in ("phone", "abroad", "card", "amex"):
                assert re.sub("[0-9]", "0", got) == re.sub("[0-9]", "0", t) and got != t
    digits = lambda t: re.sub("[^0-9]", "", new[t].replace("(0)", ""))
    assert len({digits(t)[-10:] for t in same["phone"]}) == 1 and len({digits(t) for t in same["abroad"]}) == 1 and digits("+442079460958")[:2] == "44"
    assert len({digits(t) for t in same["card"]}) == 1 and len({digits(t) for t in same["amex"]}) == 1 and new["müller@x.de"] == new["MÜLLER@x.de"]
    y, m, d = new["2024-01-15"].split("-")
    assert new["2024-01-15T10:00"] == f"{y}-{m}-{d}T10:00" and new["2024/01/15"] == f"{y}/{m}/{d}" and new["2024.01.15"] == f"{y}.{m}.{d}"
    assert new["15/01/2024"] == f"{d}/{m}/{y}" and new["01/15/2024"] == f"{m}/{d}/{y}" and new["15.01.2024"] == f"{d}.{m}.{y}" and new["1/15/2024"] == f"{int(m)}/{d}/{y}"


def test_pii_cards_among_numbers(spark):
    rows = [(1, "in 2024 4111 1111 1111 1111 123 and 4111 1111 1111 1111 3782 822463 10005."), (2, "1990 1991 1992 1993, 4111 1111 1111 1112, 30/02/2024, 1.2.3"), (3, "4111 1111 1111 1111 555 123 4567")]
    out = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "key").collect()}
    assert "4111 1111" not in out[1].text and "822463" not in out[1].text and out[1].n_replaced == 3 and out[1].text.startswith("in 2024 ")
    assert out[2].text == rows[1][1] and out[2].n_replaced == 0 and out[2].kinds == ""
    assert "4111" not in out[3].text[:4] and "123 4567" not in out[3].text and out[3].kinds == "card,phone" and out[3].n_replaced == 2


def test_feistel_permutes(spark):
    n = 30 * 41
    moved = spark.range(n).select(pii.feistel((F.col("id") / 41).cast("long"), F.col("id") % 41, 30, 41, "k", "t").alias("x")).select((F.col("x.l") * 41 + F.col("x.r")).alias("y"))
    assert sorted(r.y for r in moved.collect()) == list(range(n))


def feistel_by_hand(left, right, a, b, kind, back=False):
    f = lambda i, half: int(hashlib.sha256(f"key|{kind}|{i}|{half}".encode()).hexdigest()[:12], 16)
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            left = (left + sign * f(i, right)) % a
        else:
            right = (right + sign * f(i, left)) % b
    return left, right


def turned_back(kind, text):
    """The value that a pseudonym stands for."""
    if kind == "ip":
        o = [int(x) for x in text.split(".")]
        left, right = feistel_by_hand(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, kind, back=True)
        return ".".join(str(x) for n in (left, right) for x in divmod(n, 256))
    if kind == "date":
        n = (date.fromisoformat(text) - date(1801, 1, 1)).days
        left, right = feistel_by_hand(*divmod(n, pii.DAYS_B), pii.DAYS_A, pii.DAYS_B, kind, back=True)
        return (date(1801, 1, 1) + timedelta(left * pii.DAYS_B + right)).isoformat()
    if kind == "ssn":
        area, group, serial = (int(x) for x in text.split("-"))
        left, right = feistel_by_hand((area - 2 if area > 666 else area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999, kind, back=True)
        area, group = divmod(left, 99)
        return f"{area + 2 if area >= 665 else area + 1:03}-{group + 1:02}-{right + 1:04}"
    digits = re.sub("[^0-9]", "", text)
    head = digits[:1] if kind == "phone" else ""
    body = digits[1:] if kind == "phone" else digits[:-1]
    half = len(body) // 2
    left, right = feistel_by_hand(int(body[:half]), int(body[half:]), 10**half, 10 ** (len(body) - half), kind, back=True)
    found = head + str(left).zfill(half) + str(right).zfill(len(body) - half)
    return "+" + found if kind == "phone" else found + luhn(found)


def luhn(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def test_pii_formats_turn_back(spark):
    """Every pseudonym, turned back by hand, is the value it stands for: no two values of a format share one."""
    rnd = random.Random(12)
    values = []
    for _ in range(150):
        payload = str(rnd.randrange(10**15)).zfill(15)
        values.append(("card", payload + luhn(payload)))
        values.append(("phone", f"+1{rnd.randrange(2 * 10**9, 10**10)}"))
        values.append(("ssn", f"{rnd.choice([*range(1, 666), *range(667, 900)]):03}-{rnd.randint(1, 99):02}-{rnd.randint(1, 9999):04}"))
        values.append(("ip", ".".join(str(rnd.randrange(256)) for _ in range(4))))
        values.append(("date", (date(1801, 1, 1) + timedelta(rnd.randrange(146097))).isoformat()))
    rows = [(k, f"x {v} y") for k, (_, v) in enumerate(values)]
    for r in pii.pseudonymise(table(spark, rows), "key").collect():
        kind, value = values[r.doc_id]
        assert r.kinds == kind and turned_back(kind, r.text[2:-2]) == value, (kind, value, r.text)
    with pytest.raises(ValueError):
        pii.pseudonymise(table(spark, rows), "")


# substrings


def brute_repeats(rows, least):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + least] for _, b in data for i in range(len(b) - least + 1))
    out = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


SHARED = "".join(random.Random(9).choice("abcdefgh ") for _ in range(420))
PASSAGES = ROWS + [(40 + k, f"start {k} " * (k % 4) + SHARED[k * 7 : 420 - k * 3] + f" end {k * k}") for k in range(14)]


# a passage of under 200 bytes in many contexts, some shared by two, also in rows without a doc_id and in rows that share one
HOT_ROWS = [(None if k % 5 == 0 else 60 + k // 2, f"{k // 2} begins " * (3 + k % 3) + SHARED[20:190] + f" and {k // 3} ends" * (2 + k % 4)) for k in range(30)]


@pytest.mark.parametrize("most", [512, 3])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)
    rows = PASSAGES + HOT_ROWS
    got = rows_of(substring_dedup.remove_repeats(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(rows, 200)


def test_halves_keep_every_window():
    rnd = random.Random(8)
    data = bytes(rnd.choice(b"abcdef") for _ in range(4000))
    start, count, anchor, _ = substring_dedup.segments(data)
    for s, n, a in zip(start.tolist(), count.tolist(), anchor.astype("int64").tolist(), strict=True):
        parts = [(0, 0, 150, data[s : s + n + 199])]
        while any(least < greatest for _, least, greatest, _ in parts):
            parts = [(first, low, high, p) for f, least, greatest, piece in parts for _, first, low, high, p in substring_dedup.halves(1, a, f, least, greatest, piece)]
        assert sorted((f, p) for f, _, _, p in parts) == [(w, data[s + w : s + w + 200]) for w in range(n)]


def test_repeats_empty(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_backward_extension(monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST", 6)
    rnd = random.Random(4)
    for _ in range(200):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 6))]
        count = Counter(s[i : i + 6] for s in strings for i in range(len(s) - 5))
        for s, flags in zip(strings, substring_dedup.repeats(strings), strict=True):
            assert [bool(x) for x in flags] == [i + 6 <= len(s) and count[s[i : i + 6]] > 1 for i in range(len(s))]


# sharding


def brute_places(spark, rows):
    """Cell and key of every text, from all rows of the text at once."""
    levels = {r.v: r.l for r in spark.createDataFrame([(v,) for v in {x for r in rows for x in r[2:4]}], "v string").withColumn("l", sharding.level_of_string(F.col("v"))).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append((levels[r[2]], levels[r[3]]))
    side = 1 << sharding.BITS
    size = lambda t: len(t.encode()) + 1
    points = {t: (*min(g), min(size(t).bit_length() - 1, side - 1)) for t, g in groups.items()}
    asked = spark.createDataFrame([(t, *p) for t, p in points.items()], "t string, x int, y int, z int")
    at = {r.t: (r.c, r.k) for r in asked.select("t", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")]).alias("c"), common.text_key("t").alias("k")).collect()}
    return at


def test_shards(spark):
    rows = [(d, t, None if k % 4 == 0 else "en", f"src{k % 3}") for k, (d, t) in enumerate(ROWS * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard(docs).collect()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in order] == list(range(len(rows)))
    # cells ascend along the curve, and copies of a text follow each other in the cell of their smallest language and source
    want = brute_places(spark, rows)
    cell = {key: c for c, key in want.values()}
    assert [r.cell for r in order] == sorted(cell[r.text_key] for r in order)
    seen = [r.text_key for r in order]
    assert all(seen[i] == seen[i - 1] or seen[i] not in seen[:i] for i in range(1, len(seen)))
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_with_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 16)
    rows = [(k, "same text", "en", f"src{k % 3}") for k in range(200)] + [(1000 + k, f"text {k // 2}", "de", None) for k in range(300)] + [(7, "same text", "en", "src1")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted(sharding.shard(docs).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.place for r in out] == list(range(600)) and set(Counter(r.shard for r in out).values()) == {75}
    own = [r.place for r in out if r.text_crc32 == zlib.crc32(b"same text")]
    assert own[-1] - own[0] == 299  # one stretch, though it forms many parts
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)


def test_write_shards(spark, tmp_path):
    docs = table(spark)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert set(back.columns) == {*docs.columns, "shard_no"} and rows_of(back, "doc_id", "text") == Counter(ROWS)
    one = {(r.doc_id, r.text_key): r.shard for r in sharding.shard(docs, 4).collect()}
    assert {r.shard_no for r in back.collect()} <= set(one.values())


def test_hilbert_neighbours(spark):
    side = 1 << sharding.BITS
    grid = spark.range(side**3).select((F.col("id") / side**2).cast("int").alias("x"), ((F.col("id") / side).cast("int") % side).alias("y"), (F.col("id") % side).cast("int").alias("z"))
    place = {r.h: (r.x, r.y, r.z) for r in grid.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")])).collect()}
    assert sorted(place) == list(range(side**3))
    for h in range(side**3 - 1):  # the curve moves by one step along one axis
        assert sum(abs(a - b) for a, b in zip(place[h], place[h + 1], strict=True)) == 1


# classifiers


def labelled(spark, n=900):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.25
        w = [rnd.choice(["river", "stone", "light", "garden", "window", "paper"]) for _ in range(rnd.randint(10, 60))]
        if not good:
            w = [x + "$$$" for x in w]
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["horrid", "vileness"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    test = [(i, q) for i, q, _ in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in truth) and len(test) > 100
    assert sum(got[i].predicted == q for i, q in test) / len(test) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted == 1}


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    test = [(i, t) for i, _, t in truth if got[i].held_out]
    assert sum(got[i].predicted == t for i, t in test) / len(test) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (8, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for docs, n in ((table(spark), len(ROWS)), (empty(spark), 0)):
            out = module.score(docs, module.fit(docs, labels)).collect()
            assert len(out) == n and all(0 <= r.score <= 1 for r in out)


def test_pu_risk_never_learns_from_negative_labels(spark):
    """Other rows as the known negatives, as many of them, and the model is the same to the last bit."""
    docs, _, truth = labelled(spark, 500)
    free = [(i, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 5]
    toxic, clean = [i for i, t in free if t], [i for i, t in free if not t]
    half = len(clean) // 2
    models = []
    for negatives in (clean[:half], clean[half : 2 * half]):
        labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in negatives], "doc_id long, toxic int")
        models.append(toxicity.fit(docs, labels))
    assert (models[0][0] == models[1][0]).all() and models[0][1] == models[1][1] and models[0][0].any()


def test_toxicity_learns_from_every_block(spark):
    docs, labels, truth = labelled(spark, 700)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels, block_rows=200)).collect()}
    test = [(i, t) for i, _, t in truth if got[i].held_out]
    assert sum(got[i].predicted == t for i, t in test) / len(test) > 0.95


GIVEN = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(GIVEN).exists(), reason="no test tables")
@pytest.mark.parametrize("module,column,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_given_labels_held_out(spark, module, column, least):
    """Share of right predictions among the given held-out labels; four in ten rows labelled toxic hold no toxic word."""
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    found = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("predicted", column).collect()
    assert len(found) > 50 and sum(r[0] == r[1] for r in found) / len(found) >= least


# operators whose joins spread hot keys, and layouts


def test_join_sized_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    monkeypatch.setattr(common, "SMALL_GROUP", 3)
    rows = [(1 if i % 3 == 0 else i % 40, i % 2, None if i % 7 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, j long, by long")
    groups = df.filter("k < 20").groupBy("k", "j").agg(F.count("*").alias("size"), F.sum("by").alias("s"))
    got = Counter(tuple(r) for r in common.join_sized(df, groups, ["k", "j"], "size", "by", 300).select("k", "j", "by", "s").collect())
    assert got == Counter(tuple(r) for r in df.join(groups, ["k", "j"]).select("k", "j", "by", "s").collect()) and sum(got.values()) > 100


def test_segments_of_one_anchor_and_other_bytes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    monkeypatch.setattr(common, "SMALL_GROUP", 2)
    rnd = random.Random(11)
    common_part = "".join(rnd.choice("abcdefgh") for _ in range(260))  # one anchor in most rows
    rows = [(i, "".join(rnd.choice("ijklmnop") for _ in range(rnd.randint(0, 150))) + common_part + "".join(rnd.choice("qrstuvwx") for _ in range(rnd.randint(0, 150)))) for i in range(60)] + [(None, common_part), (3, None)]
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        want[i, sum(gone)] += 1
    got = substring_dedup.remove_repeats(table(spark, rows))
    assert rows_of(got, "doc_id", "n_removed") == want
    anchor, digest = (substring_dedup.np.array([1, 1, 2, 1, 2], "u8"), substring_dedup.np.array([5, 6, 5, 5, 5], "u8"))
    own, times, kind = substring_dedup.kinds_of(anchor, digest)
    assert (own.tolist(), times.tolist(), kind.tolist()) == ([0, 1, 2], [2, 1, 2], [0, 1, 2, 0, 2])


def test_one_end_in_most_pairs(spark, monkeypatch):
    """The smallest id of a star is the first end of nearly all its pairs."""
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    monkeypatch.setattr(common, "SMALL_GROUP", 2)
    base = [str(i) for i in range(120)]
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[41:])) for i in range(40)]
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows)


def test_addresses_with_leading_zeros_are_no_addresses(spark):
    rows = [(1, "at 10.1.2.3 and 010.1.2.3 or 10.01.2.3, 0.0.0.0 and 1.2.3.00")]
    out = pii.pseudonymise(table(spark, rows), "k" * 32).collect()[0].asDict()
    text = next(v for k, v in out.items() if k in ("text", "pseudonymised", "clean") and v)
    assert "010.1.2.3" in text and "10.01.2.3" in text and "1.2.3.00" in text and "10.1.2.3 and" not in text.replace("010.1.2.3", "")


def test_toxicity_does_not_hang_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = toxicity.fit(docs.coalesce(1), known)
    other = toxicity.fit(docs.repartition(5, "source").sortWithinPartitions(F.desc("doc_id")), known)
    assert (one is None and other is None) or ((one[0] == other[0]).all() and one[1] == other[1])
