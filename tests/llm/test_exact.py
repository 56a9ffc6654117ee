"""Merkle manifest, repeated bytes and periodic runs against brute force, with odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import merkle, periodic, suffix

SCHEMA = "doc_id long, text string, source string, _row string, _key string, _group string, runs string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def odd_rows():
    shared = prose(7, 30)
    rows = [(1, "", "s", "x"), (2, None, None, None), (None, "null id " + shared, "s", "x"), (3, prose(1, 12000), "b", ""), (4, "twice " * 40, "b", ""), (4, "twice " * 40, "b", ""), (5, "a\n\n  b\té \U0001f600 " + shared, None, "")]
    rows += [(10 + i, prose(i, 20) + " " + shared * (i % 3) + prose(90 - i, i), "s" if i % 2 else "hot", "y") for i in range(40)]
    return [(*r, "k", "g", "r") for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture
def many_pieces(spark):
    """Small sorted pieces stay apart, so that trees and buckets cross their edges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- Merkle ---------------------------------------------------------------------------------------------------------


def steps(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        low = i // fanout * fanout
        run = nodes[low : low + fanout]
        out.append(("".join(run[: i - low]), "".join(run[i - low + 1 :])))
        i //= fanout
    return out


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute_manifest(rows, fanout):
    """(key, leaf, subroot, root, path) of rows (key, group, fields)."""
    groups = {}
    for key, group, values in rows:
        leaf = digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    outer = tree([inner[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (known, key, leaf) in enumerate(sorted(groups[g])):
            out.append((key if known else None, leaf, inner[g][-1][0], outer[-1][0], steps(inner[g], i, fanout) + steps(outer, k, fanout)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[4])))


@pytest.mark.parametrize("fanout,n,groups", [(2, 61, 5), (3, 130, 1), (16, 400, 40)])
def test_merkle_equals_brute_force_over_pieces(spark, many_pieces, fanout, n, groups):
    rows = [(i, f"g{(i * i) % groups:02d}" if i % 3 else "hot", f"text {i} é") for i in range(n)]
    proofs, records = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"), fields=["doc_id", "text"], fanout=fanout)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in proofs.collect()]
    assert order(got) == order(brute_manifest([(k, g, (k, t)) for k, g, t in rows], fanout))
    assert all(digest(r.nodes) == r.digest for r in records.collect())
    assert proofs.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_merkle_odd_rows_and_tampering(spark, many_pieces):
    docs = odd(spark)
    changed = merkle.leaf_digest(F.col("doc_id"), F.upper("text"))
    proofs, _ = merkle.manifest(docs, fields=["doc_id", "text"], carry={"changed": changed})
    rows = proofs.withColumn("folded", merkle.fold(F.col("changed"), F.col("path"))).collect()
    want = brute_manifest([(r[0], r[2], (r[0], r[1])) for r in odd_rows()], 16)
    assert order([(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in rows]) == order(want)
    assert all((r.folded == r.root) == (r.changed == r.leaf) for r in rows)
    assert merkle.manifest(docs.limit(0), fields=["text"])[0].collect() == []
    one = merkle.manifest(docs.filter("doc_id = 3"), fields=["text"])[0].first()
    assert one.leaf == one.subroot == one.root and one.path == []


# --- suffix arrays --------------------------------------------------------------------------------------------------


def test_two_stage_order_equals_sorted_suffixes():
    r = random.Random(5)
    for _ in range(150):
        parts = [bytes(r.choice(r.choice([b"ab", bytes(range(1, 256)), b"a"])) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 8))]
        text, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])

        def suffix_of(i, parts=parts, ends=ends):
            s = int(np.searchsorted(ends, i, side="right"))
            return parts[s][i - (ends[s] - len(parts[s])) :]

        want = sorted(map(suffix_of, range(len(text))))
        assert [suffix_of(i) for i in suffix.two_stage(text, ends).tolist()] == want
        needed = np.array([r.random() < 0.4 for _ in range(len(text))], dtype=bool)
        some = [suffix_of(i) for i in suffix.two_stage(text, ends, needed=needed).tolist() if needed[i]]
        assert some == sorted(suffix_of(i) for i in np.flatnonzero(needed).tolist())


def test_common_prefixes():
    text = np.frombuffer(b"abcabcabcabcabcabcabd" * 3, dtype=np.uint8)
    ends = np.array([len(text)])
    order_ = suffix.two_stage(text, ends)
    order_ = order_[order_ <= len(text) - 20]
    raw = text.tobytes()
    common = [next((k for k in range(20) if raw[a + k] != raw[b + k]), 20) for a, b in zip(order_, order_[1:], strict=False)]
    assert suffix.common_prefixes(text, order_, 20).tolist() == [0, *common]


def brute_repeats(rows, length):
    low = lambda k: -(1 << 63) if k is None else k
    first = {}
    for key, text in sorted(rows, key=lambda r: low(r[0])):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], low(key))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < low(key):
                gone[i : i + length] = b"\1" * length
        out.append((key, len(raw), sum(gone), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,many", [(50, 4096), (20, 4096), (50, 0), (17, 1)])
def test_repeated_bytes_equal_brute_force(spark, many_pieces, length, many):
    """With ``many`` at 0 or 1 the windows of (almost) all shared anchors are dealt out one by one."""
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100, "a" * 300), (101, "b" + "a" * 200 + "b"), (102, "\0" * 120), (103, "x" + "\0" * 130), (104, "ab" * 90), (99, "ba" * 60 + "é" * 40)]
    found = suffix.remove_repeated_bytes(odd(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_rows()) :], "doc_id long, text string")), length=length, many=many, bucket_bytes=20000)
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), bytes(r.kept)) for r in found.collect()]
    assert sorted(got, key=str) == brute_repeats(rows, length)


def test_repeated_bytes_odd_tables(spark):
    found = suffix.remove_repeated_bytes(odd(spark))
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), bytes(r.kept)) for r in found.collect()]
    assert sorted(got, key=str) == brute_repeats([(r[0], r[1]) for r in odd_rows()], 50)
    assert suffix.remove_repeated_bytes(odd(spark).limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffix.remove_repeated_bytes(odd(spark), length=8)


# --- periodic runs --------------------------------------------------------------------------------------------------


def brute_runs(words, min_length=12, min_exp=2):
    n, out = len(words), []
    for start in range(n):
        for q in range(1, n // min_exp + 1):
            if start + q > n or (start and start - 1 + q < n and words[start - 1] == words[start - 1 + q]):
                continue
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            part = words[start:end]
            if len(part) >= max(min_length, min_exp * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, len(part), q))
    return out


def brute_collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loops(seed):
    r = random.Random(seed)
    letters = r.choice(["ab", "abcdefgh"])
    words = [r.choice(letters) for _ in range(r.randint(0, 50))]
    unit, at = [r.choice(letters) for _ in range(r.randint(1, 9))], r.randint(0, len(words))
    return words[:at] + unit * r.randint(1, 9) + words[at:]


@pytest.mark.parametrize("lags", [4096, 3])
def test_runs_equal_brute_force(spark, lags):
    """With three shifts to a range most texts are read by several tasks."""
    texts = [(i, " \n".join(loops(i))) for i in range(80)]
    found = periodic.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string"), lags=lags).collect()
    assert len(found) == 80
    for r in found:
        words = dict(texts)[r.doc_id].split()
        want = brute_runs(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == want
        assert (r.n_words, r.collapsed) == (len(words), brute_collapse(words, want))


def test_runs_odd_tables_and_edit(spark):
    found = periodic.periodic_runs(odd(spark), edit=periodic.loop_tail, lags=500).collect()
    want = []
    for r in odd_rows():
        words = periodic.WORD.findall(r[1] or "")
        h, n = zlib.crc32(str(r[0]).encode()), len(words)
        if r[0] is not None and h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append((r[0], len(words), len(brute_runs(words)) if n < 2000 else None, digest(" ".join(words)) if n >= 2000 else None))
    got = [(r.doc_id, r.n_words, len(r.runs) if r.n_words < 2000 else None, digest(r.collapsed) if r.n_words >= 2000 else None) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(odd(spark).limit(0)).collect() == []
    rows = periodic.digests(periodic.periodic_runs(odd(spark))).filter("doc_id = 4").collect()
    assert len(rows) == 2 and (rows[0].n_runs, rows[0].start, rows[0].length, rows[0].period, rows[0].exponent_milli) == (1, 0, 40, 1, 40000)
    assert rows[0].runs_sha256 == digest("0,40,1\n") and rows[0].collapsed_sha256 == digest("twice")
