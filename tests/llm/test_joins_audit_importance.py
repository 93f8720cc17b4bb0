"""Filter audit, importance resampling and the n-gram Jaccard join against slow versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from corpuscle.llm import filter_audit, importance, prefix_join

from .samples import documents, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def slow_fails(rows):
    """The failed filters of (doc_id, text) rows."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        w = WORD.findall(t)
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x in rows),
        }
        out.append({k for k, v in failed.items() if v})
    return out


def slow_audit(rows, parts, good, toxic):
    failed = slow_fails(rows)
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in set(parts):
            left = [i for i, p in enumerate(parts) if p == part]
            every = list(left)
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in failed[i]]
                rest = set(left)
                redundant = sum(letter in failed[i] for i in every if i not in rest)
                left = [i for i in left if letter not in failed[i]]
                shapley[part, letter] += len(gone)
                unique = sum(failed[i] == {letter} for i in every)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
    return sorted(((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()), key=str)


def test_filter_audit_equals_slow_version(spark):
    rows = [*documents(), (200, "#tag A B " + prose(3, 60)), (201, "UPPER CASE WORDS " * 20), (202, documents()[0][1]), (202, documents()[0][1]), (203, "\x00\x1f\x85 ok " * 30)]
    parts = [["src0", "src0", None, "other", ""][i % 5] for i in range(len(rows))]
    docs = spark.createDataFrame([(*r, p, 1, "c", True) for r, p in zip(rows, parts)], "doc_id long, text string, source string, n_words long, digest string, copy boolean")
    labels = [(0, 1, 0), (0, 0, 1), (103, 1, 1), (202, 1, None), (106, 0, 0), (None, 1, 1), (999, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    want = slow_audit(rows, [p or "" for p in parts], good, toxic)
    assert rows_of(filter_audit.audit(docs, given)) == want
    assert filter_audit.audit(docs.limit(0), given).count() == 0
    two = filter_audit.audit(docs, given.limit(0), {"X": "n_words < 50", "Y": "n_symbols > 0"})
    assert two.where("part = ''").count() == 4


@pytest.mark.parametrize("piece, base", [(1 << 20, 0x100000001B3), (16, 0x100000001B3), (64, 1)])
def test_word_scan_in_pieces_and_with_equal_hashes(piece, base):
    """A base of 1 gives all anagrams one hash: the comparison of bytes has to tell them apart."""
    rng = random.Random(4)
    texts = ["", " \n", "abc cab bca abc", "ÄÖ ÖÄ Ä", "x" * 300, "a b " * 50 + "A", "one", *["".join(rng.choice("ab \nÄ|B") for _ in range(200)) for _ in range(30)]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    got = filter_audit.WordScan(piece, base).count(data, offsets)
    want = [[len(w := WORD.findall(t)), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)] for t in texts]
    assert got.tolist() == want


def slow_features(text):
    w = TERM.findall((text or "").translate(LOWER))
    return w, Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def slow_resample(rows, target, percent=5, min_words=20, buckets=10_000):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f, n in slow_features(text)[1].items():
                counts[bucket(f)] += n
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, (doc_id, text) in enumerate(rows):
        w, features = slow_features(text)
        weight = sum(gain[bucket(f)] * n for f, n in features.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, sum(features.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_equals_slow_version(spark, percent):
    rows = [*documents(), (300, "Émile, 3.5 o'clock x\x00y " * 12), (301, "a b"), (302, "a")]
    rows = [r for r in rows if r[0] != 106] + [(106, prose(9, 3000))]
    target = [prose(77, 200), None, "", "Émile o clock"]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, weight int, rank int, score int")
    given = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    assert rows_of(importance.resample(docs, given, percent)) == slow_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark):
    docs = table(spark, [])
    assert importance.resample(docs, docs).count() == 0
    one = importance.resample(table(spark, [(1, prose(1, 30))]), docs, percent=100).collect()
    assert [r["rank"] for r in one] == [1]


def test_ngram_runs_across_blocks(spark, monkeypatch):
    """Long texts are cut into blocks of places; n-grams across a cut count once."""
    rows = [(1, prose(1, 500)), (2, "the same words " * 100), (3, prose(1, 500))]
    texts = [r[1] for r in rows]
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(importance, "POSITIONS", size)
        found = Counter()
        for *block, _ in importance._blocks(texts):
            for crc, run_of, places in importance.ngram_runs(*block):
                assert len(run_of) == len(places)
                found.update(dict(zip(crc.tolist(), np.bincount(run_of, minlength=len(crc)).tolist())))
        want = Counter()
        for t in texts:
            for f, n in slow_features(t)[1].items():
                want[zlib.crc32(f.encode())] += n
        assert found == want


def slow_join(rows, percent, words=4):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    """Groups of near copies of two to many, a passage that many texts share, short texts, and all of ``documents``."""
    rng = random.Random(11)
    rows = [r for r in documents() if r[0] != 106] + [(106, prose(8, 2000)), (506, prose(8, 2000) + " more")]
    passage = prose(500, 30)
    at = 1000
    for group, size in enumerate([2, 3, 5, 60]):
        base = prose(600 + group, 90).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(at + i, f"{passage} {prose(3000 + i, 5)}") for i in range(50)]
    rows += [(at + 100 + i, " ".join(["a", "b", "c", "d", "e", "f", "g", "h"][: 1 + i % 8])) for i in range(20)]
    return rows


@pytest.mark.parametrize("percent, crowd, tile, counted", [(85, 32, 1 << 18, 0.2), (85, 2, 300, 0.2), (60, 4, 1000, 0.2), (85, 32, 1 << 18, 0.0), (95, 3, 500, 1.0)])
def test_jaccard_join_equals_slow_version(spark, percent, crowd, tile, counted):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], "doc_id long, text string, mark string, node long, n long")
    assert rows_of(prefix_join.join_similar(docs, percent, crowd=crowd, tile=tile, counted=counted)) == slow_join(rows, percent)


def test_jaccard_join_of_empty_tables(spark):
    assert prefix_join.join_similar(table(spark, [])).count() == 0
    blank = [(1, None), (2, ""), (None, " "), (2, "")]
    assert rows_of(prefix_join.join_similar(table(spark, blank))) == sorted([(1, 0, 1), (2, 0, 2), (None, 0, None), (2, 0, 2)], key=str)


def test_prefix_demands_more_where_postings_are_long():
    """Frequent tokens make a longer prefix, which demands more matches, worth while."""
    rare = prefix_join.choose_prefix(np.full(30, 2), np.arange(30), 100, 85)
    hot = prefix_join.choose_prefix(np.array([500] * 16 + [600] * 14), np.arange(30), 400, 85)
    assert rare[0] <= hot[0] and hot == (hot[0], prefix_join.spare(400, 85) + hot[0])
