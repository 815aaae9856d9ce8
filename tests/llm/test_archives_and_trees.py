"""Prefix trie, WARC archives and whitening against brute force, and on odd rows."""

import base64
import collections
import gzip
import hashlib
import os
import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import prefix_trie as pt, warc, whitening as wh
from quayside.session import scratch_dir

SF = "/root/testdata/sf0.001"


# -- 11: prefix trie -----------------------------------------------------------------------

def brute_trie(rows, group=20):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for v in by.values():
        v.sort(key=lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    turns = {c: [(r[2], r[3]) for r in v] for c, v in by.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - int(np.fmod(c, group)), [])[:h] + own[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(warc_words(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=str)


def warc_words(t):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def some_conversations(n=400, seed=4):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 7)):
            role, text = ("user", "assistant")[t % 2], rnd.choice(["a b", "a b c", "", "x", f"own {c}"] if t else ["hello there", "hi", "hello there"])
            rows.append((c * rnd.choice([1, 1, 3]), None if rnd.random() < 0.05 else t, role if rnd.random() > 0.1 else None, text if rnd.random() > 0.1 else None))
    rows += [(-5, 1, "user", "hi"), (-20, 1, "user", "minus"), (None, 1, "user", "nobody"), (1000, None, None, None)]
    rows += [(999, t, "user", "word") for t in range(300)] + [(998, 3, "user", "same")] * 50
    return rows


@pytest.mark.parametrize("residue", [50_000, 40])
def test_prefix_trie_equals_brute_force(spark, residue):
    rows = some_conversations()
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, pos string, depth int")
    turns, convs = pt.shared_heads(pt.ordered_turns(df))
    got = sorted((tuple(r) for r in pt.prefix_trie(turns, convs, residue).collect()), key=str)
    assert got == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_turnless_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    def build(rows):
        return [tuple(r) for r in pt.prefix_trie(*pt.shared_heads(pt.ordered_turns(spark.createDataFrame(rows, kind)))).collect()]
    assert build([]) == [] and build([(None, 1, "u", "t")]) == []
    alone = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its only turn is replaced by an absent one
    assert build([(alone, 1, "u", "t")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_running_totals_and_order_over_many_blocks(spark):
    rows = [(g, p, (p * 7 + g) % 11) for g in (1, 2) for p in range(700)]
    df = spark.createDataFrame(rows, "g long, p long, v long")
    got = {(r.g, r.p): (r.s, r.x) for r in pt.running(pt.running(df, ["g"], "p", {"s": "v"}, 699, width=8), ["g"], "p", {"x": "v"}, 699, "bit_xor", 8).collect()}
    for g in (1, 2):
        s = x = 0
        for p in range(700):
            s, x = s + (p * 7 + g) % 11, x ^ ((p * 7 + g) % 11)
            assert got[g, p] == (s, x)
    hot = spark.range(5000).select(F.lit(1).alias("g"), F.lit(2).alias("v"))  # equal rows only
    placed = pt.in_order(hot, ["g"], [F.col("v")], "equal").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(5000))
    assert [r.next_at for r in placed] == [r["at"] for r in placed[1:]] + [None]


def test_list_ranking_of_a_shuffled_list(spark):
    ids = list(range(-3000, 3000, 2))
    random.Random(1).shuffle(ids)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], None])), "id long, next long")
    got = {r.id: r.pos for r in pt.list_rank(arcs, residue=50).collect()}
    assert got == {x: i for i, x in enumerate(ids)}


# -- 12: WARC ------------------------------------------------------------------------------

def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def round_trip(spark, pages, **options):
    path = scratch_dir(spark, "test-warc")
    warc.write_warc(pages, path, **options)
    return warc.resolve_revisits(warc.assemble(warc.read_records(spark, f"{path}/records"))).collect()


def test_warc_round_trip_of_odd_payloads(spark):
    rnd = random.Random(3)
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "a", "é", "WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\x00", " ", "🙂"]
    rows = [(i, None if i % 7 == 0 else f"http://a b/\r\nX: {i}", None if i % 11 == 0 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))), 5) for i in range(600)]
    rows += [(None, None, None, 1), (None, None, None, 1), (None, "n", "null key", 1), (700, "u", "same", 1), (700, "u", "same", 1), (700, "v", "same", 1),
             (3, "w", "same", 1), (701, "u", "x" * 3_000_000, 1)]
    got = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, record_id int"))
    data = [(k, (h or "").encode()) for k, _, h, _ in rows]
    assert collections.Counter((r.key, r["of"].payload_bytes, r["of"].payload_digest) for r in got) == collections.Counter((k, len(d), b32(d)) for k, d in data)
    top = {}
    for k, d in data:
        top[d] = max(top.get(d, -1), -1 if k is None else k)
    assert all((r["of"].key if r["of"].key is not None else -1) == top[d] for r in got for d in [next(d for d in top if b32(d) == r["of"].payload_digest)])
    responses = [r for r in got if r.capture.record_type == "response"]
    assert sorted(bytes(r.capture.payload) for r in responses) == sorted(top)
    assert all((r.n_requests, r.n_metadata) == (1, 1) and r.request.record_id and r.metadata.record_id for r in got)
    assert all(r.capture.declared_digest == f"sha1:{r['of'].payload_digest}" for r in got)
    assert {r.capture.target_uri for r in got if r.key == 1} == {"http://a%20b/%0D%0AX:%201"}
    assert all(r.capture.target_uri is None for r in got if r.key is not None and r.key < 600 and r.key % 7 == 0)


def test_warc_small_payloads_and_empty_tables(spark):
    kind = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy"), (3, "a", "long enough"), (4, "a", "long enough")], kind)
    got = {r.key: (r.capture.record_type, r["of"].key) for r in round_trip(spark, pages, least=5)}
    assert got == {1: ("response", 1), 2: ("response", 2), 3: ("revisit", 4), 4: ("response", 4)}
    assert round_trip(spark, pages.limit(0)) == []


def test_warc_reads_foreign_archives(spark):
    """Per-record gzip members, several metadata records, unknown links, a torn record."""
    def rec(kind, rid, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    body = bytes(range(256)) * 3 + b"\r\n\r\n\r\n"
    records = [rec("warcinfo", "<i>", b"software: x\r\n"), rec("response", "<r>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, "WARC-Target-URI: http://x/"),
               rec("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>"), rec("metadata", "<m2>", b"a: 2", "WARC-Concurrent-To: <r>"),
               rec("metadata", "<m1>", b"a: 1", "WARC-Concurrent-To: <q>"), rec("metadata", "<m3>", b"a: 3", "WARC-Concurrent-To: <nowhere>"),
               rec("revisit", "<v>", b"", "WARC-Refers-To: <gone>"), rec("response", "<torn>", b"HTTP/1.1 200 OK\r\n\r\nabc")[:-9]]
    folder = scratch_dir(spark, "foreign").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records))
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(gzip.compress(records[1].replace(b"<r>", b"<s>")))
    got = {r.capture.record_id: r for r in warc.resolve_revisits(warc.assemble(warc.read_records(spark, folder))).collect()}
    assert set(got) == {"<r>", "<s>", "<v>"}
    assert bytes(got["<r>"].capture.payload) == body and got["<s>"].capture.payload_digest == b32(body)
    assert (got["<r>"].metadata.record_id, got["<r>"].n_metadata, got["<r>"].request.record_id) == ("<m1>", 2, "<q>")
    assert got["<v>"]["of"] is None and got["<v>"].request is None and got["<v>"].n_requests == 0


# -- 13: whitening -------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, x string")


def check_whitened(got, rows, count=4):
    x = [None if v is None or not v or any(c is None or not np.isfinite(c) for c in v) else [int(np.floor(256 * c)) for c in v] for v in rows]
    fit = sorted({tuple(v) for v in x if v is not None})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[n * v[j] - s[j] for j in range(d)] for v in fit], float) / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    assert {r.vec_id for r in got} == {i for i, v in enumerate(x) if v is not None}
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, count + 1):
        ids = [i for i, v in enumerate(x) if v is not None]
        a = np.array([by[i, c].whitened for i in ids])
        b = np.array([(np.array([n * x[i][j] - s[j] for j in range(d)], float) / n) @ vec[:, c - 1] / np.sqrt(e[c - 1]) for i in ids])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
        assert all(abs(by[i, c].explained - e[c - 1] / e.sum()) < 1e-9 for i in ids)
        assert all(by[i, c].deviation == sum((n * x[i][j] - s[j]) ** 2 for j in range(d)) and by[i, c].n == n for i in ids)
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(300, 7)) * [3, 2.5, 2, 1.5, 1, 0.5, 0.25]).tolist()
    rows += rows[:50] + [rows[0]] * 100 + [None, [], [1, None, 0, 0, 0, 0, 0], [float("nan")] + [0] * 6, [float("-inf")] + [0] * 6, [-0.0] * 7]
    check_whitened(wh.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_the_table(spark):
    src = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = wh.op13_whitening(spark, SF).collect()
    rows = [list(map(float, r.embedding)) for r in src.orderBy("vec_id").collect()]
    assert len(got) == 4 * len(rows)
    check_whitened(got, rows)


def test_whitening_of_few_dimensions_ties_and_huge_entries(spark):
    cross = [[1, 0], [0, 1], [-1, 0], [0, -1]]
    got = wh.whiten(vectors(spark, cross)).collect()  # a double eigenvalue
    assert sorted({r.component for r in got}) == [1, 2] and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-9 for r in got)
    line = wh.whiten(vectors(spark, [[v] * 3 for v in range(5)])).collect()  # rank one
    assert {r.component for r in line} == {1} and line[0].explained == 1.0
    assert wh.whiten(vectors(spark, [[1, 0], [1, 0]])).collect() == [] and wh.whiten(vectors(spark, [None, []])).collect() == []
    assert wh.whiten(vectors(spark, cross).limit(0)).count() == 0
    odd = wh.whiten(vectors(spark, [[1e30, 0], [0, 1], [3, -1e300], [1], [2]])).collect()  # two short vectors take no part
    assert {r.vec_id for r in odd} == {0, 1, 2} and any(r.deviation is None for r in odd) and all(np.isfinite(r.whitened) for r in odd)


def test_scatter_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-1 << 62, 1 << 62, (9000, 3)), rng.integers(-500, 500, (100, 3))])
    df = spark.createDataFrame([(row,) for row in x.tolist()], "x array<long>")
    n, s, m = wh.scatter(df, 3)
    big = x.astype(object)
    assert n == len(x) and s == [sum(big[:, j]) for j in range(3)]
    assert m == [[n * sum(big[:, i] * big[:, j]) - s[i] * s[j] for j in range(3)] for i in range(3)]
    # roots 1, 4, 4 and 9 after a rotation that keeps integers
    a = np.diag([1, 4, 4, 9]).astype(object) * 9
    q = np.array([[2, 1, 2, 0], [-2, 2, 1, 0], [1, 2, -2, 0], [0, 0, 0, 3]], object)
    poly = wh.characteristic_polynomial(spark, (q.T @ a @ q).tolist())
    want = [1]
    for r in (81, 324, 324, 729):
        want = [(want[i - 1] if i else 0) - r * (want[i] if i < len(want) else 0) for i in range(len(want) + 1)]
    assert poly == want
    roots = wh.largest_roots(poly, 3)
    assert [m for _, _, m in roots] == [1, 2] and [round(Decimal(a) / 2 ** s) for a, s, _ in roots] == [729, 324]
    assert [wh.roots_above(poly, v, 0) for v in (0, 81, 323, 324, 728, 729)] == [4, 3, 3, 1, 1, 0]
    basis = wh.null_space((q.T @ a @ q).tolist(), *roots[1], 60)
    for v in basis:
        u = (q.T @ a @ q) @ np.array(v, object)
        assert all(abs(u[i] - 324 * v[i]) < Decimal("1e-20") for i in range(4))
    assert len(wh.primes_below(1 << 31, 3)) == 3 and wh.polynomial_mod(np.array([[2, 1], [1, 2]]), 7) == [3, 3, 1]
