"""Embedding dedup, chat formatting, mixing, WARC, resharding, pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askframe.llm import chat_format, embedding_dedup, mixing, packing, resharding, toxicity, warc
from askframe.llm.common import components, words, written
from askframe.llm.queries import op5_chat_formatting, op8_warc, table, vocabulary

SF = "/root/testdata/sf0.001"


# -- components ----------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 130)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(500, i) for i in range(400, 420)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- embeddings ----------------------------------------------------------------------------------------------------------


def near_vectors(n=300, dim=32, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    out, labels = [], []
    for i, v in enumerate(base):
        label = ["a", "b", "c"][i % 3] if i % 2 else "a"
        for _ in range(r.integers(1, 6)):
            away = r.normal(size=dim)
            away *= np.linalg.norm(v) / np.linalg.norm(away) * r.uniform(0, 0.25)
            out.append((v + away) * r.uniform(0.5, 2))
            labels.append(label)
        out.append(out[-1])
        labels.append(label)
    return np.array(out, dtype=np.float32), labels


def brute_links(x, labels):
    """Links and components of vectors, in blocks."""
    u = embedding_dedup.unit(x.astype(np.float64))
    labels = np.array(labels)
    n, comp = np.zeros(len(u), dtype=int), np.arange(len(u))
    hits = []
    for at in range(0, len(u), 1000):
        hit = (u[at : at + 1000] @ u.T >= 0.98) & (labels[at : at + 1000, None] == labels[None, :])
        hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
        n[at : at + 1000] = hit.sum(axis=1)
        hits.append(hit)
    while True:
        least = np.concatenate([np.minimum(comp[1000 * i : 1000 * i + len(h)], np.where(h, comp[None, :], len(u)).min(axis=1)) for i, h in enumerate(hits)])
        if (least == comp).all():
            return n, comp
        comp = least


def vectors_table(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), lab, 0) for i, (v, lab) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label string, copies int")


def test_near_vectors_match_brute_force(spark):
    x, labels = near_vectors()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors_table(spark, x, labels), "vec_id", "embedding", "label").collect()}
    n, comp = brute_links(x, labels)
    assert n.sum() > 1000
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.995 * n.sum()  # recall; no false link
    assert np.mean([got[i].component_id == c for i, c in enumerate(comp)]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def low_rank(n, rank, mean, seed, dim=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, rank)) @ r.normal(size=(rank, dim))
    return (x + mean * r.normal(size=dim)).astype(np.float32)


@pytest.mark.parametrize("rank, mean", [(3, 0), (6, 0), (6, 4), (6, 8)])
def test_recall_on_vectors_of_few_directions(spark, rank, mean):
    """Neighbours of such vectors lie along the data's own directions, or everywhere."""
    x = low_rank(3000, rank, mean, rank + mean)
    labels = ["a"] * len(x)
    rows = embedding_dedup.near_duplicates(vectors_table(spark, x, labels), "vec_id", "embedding", "label").collect()
    n, comp = brute_links(x, labels)
    found = np.array([r.n_links for r in sorted(rows, key=lambda r: r.vec_id)])
    assert n.sum() > 500 and (found <= n).all() and found.sum() >= 0.99 * n.sum()


def test_blocks_count_every_pair_once(monkeypatch, spark):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "least_margin", lambda counts, recall: np.inf)  # every cell: exact
    x, labels = near_vectors(60, 16, 3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors_table(spark, x, labels), "vec_id", "embedding", "label").collect()}
    n, comp = brute_links(x, labels)
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == comp.tolist()


def test_a_dense_cluster_is_dealt_over_bounded_blocks(monkeypatch, spark):
    r = np.random.default_rng(5)
    largest = []
    for size in (1000, 2000):
        x = (r.normal(size=64) + 0.02 * r.normal(size=(size, 64))).astype(np.float32)
        monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
        seen = []
        group = type(spark.range(0)).groupBy

        def watched(df, *by):
            if all(isinstance(c, str) for c in by) and by[-2:] == ("mine", "theirs"):
                seen.append(max(r[0] for r in group(df, *by).count().select("count").collect()))
            return group(df, *by)

        monkeypatch.setattr(type(spark.range(0)), "groupBy", watched)
        got = embedding_dedup.near_duplicates(vectors_table(spark, x, ["a"] * size), "vec_id", "embedding", "label").collect()
        monkeypatch.undo()
        assert {r.n_links for r in got} == {size - 1} and {r.component_id for r in got} == {0}
        largest.append(max(seen))
    assert max(largest) <= 3 * 256


def test_traversal_visits_all_cells_within_the_margin():
    r = np.random.default_rng(4)
    index = embedding_dedup.MultiIndex(r.normal(size=(7, 4)), r.normal(size=(9, 4)), 1.5)
    x = embedding_dedup.unit(r.normal(size=(20, 8)))
    d1, d2 = index.halves(x)
    for i, rows in enumerate(index.visited_rows(d1, d2)):
        s = d1[i][:, None] + d2[i][None, :]
        assert rows[0] == d1[i].argmin() and set(rows) == set(np.flatnonzero((s <= s.min() + 1.5).any(axis=1)))
    assert embedding_dedup.least_margin(np.array([3, 0, 1]), 0.75) == 0 and embedding_dedup.least_margin(np.array([3, 0, 1]), 1.0) == 2 * embedding_dedup.STEP


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [3e38, 1.0], 1), (14, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[12] == got[13] == [(4, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 11)) and got[10] == [(1, 10, True)] and got[14] == [(1, 10, False)] and got[None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0), "vec_id", "embedding", "label").count() == 0


# -- chats ---------------------------------------------------------------------------------------------------------------

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "[ROLE ", "<\\s>", "<\\\\/s>", "[\\NEXT]", "[\\", "\\", "<", "[", "]", "$1", "x", "é", "😀", "\n", "<|im_start|>", "<<SYS>>"]


def test_chats_round_trip(spark):
    r = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            text = None if r.random() < 0.1 else "".join(r.choice(CONTROL) for _ in range(r.randint(0, 8)))
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "tool]x", None, "assistant"]), text, "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_chats(df).select("*", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    got = {x.conv_id: x for x in out.collect()}
    for conv in range(60):
        own = [(role or "", text or "") for c, _, role, text, _ in rows if c == conv]
        assert [tuple(t) for t in got[conv].back] == own
        assert got[conv].loss == "".join(t for role, t in own if role == "assistant")
        assert [m.length for m in got[conv].loss_mask] == [m.length for m in sorted(got[conv].loss_mask)]
        # the template's own marks are the only control strings left
        assert got[conv].formatted.count("</s>") == got[conv].formatted.count("<s>[ROLE ") == sum(a[0] != b[0] for a, b in zip(own, own[1:])) + 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_query(spark):
    got = {r.conv_id: r for r in op5_chat_formatting(spark, SF).collect()}
    turns = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    ok = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", ok), ("assistant", ok)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, v in turns.items():
        loss = "".join(t for role, t in v if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(v), sha("".join(f"{a}\n{b}\n" for a, b in v)), len(loss), sha(loss))
    assert len(got) == len(turns)


def test_ties_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (None, None, None, None), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r[0]: [tuple(t) for t in r[1]] for r in chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted"))).collect()}
    assert back == {1: [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}


# -- mixing --------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, out, left = {s: most * sizes[s] for s in names}, dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    open_ = set(names)
    while left > 1e-9 and open_:
        part = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += part * w[s]
            if out[s] >= cap[s]:
                left += out[s] - cap[s]
                out[s] = float(cap[s])
                open_.remove(s)
    return out


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "B", "é", "", "z", None]), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df, (1, 2, 3), 1.0, 3.0).collect()}
    expected = brute_targets(sizes, (1, 2, 3), 3)
    assert set(got) == set(expected) and all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in got)


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, None if i % 50 == 0 else " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "a", "a", "b", "c", None]), "n") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_rank string")
    out = mixing.mix(df, "doc_id", "source", words(F.col("text")))
    got = out.collect()
    assert len(got) == 3000 and out.columns == [*df.columns, "size", "source_size", "target", "copies"]
    by = defaultdict(list)
    for x in got:
        assert x.size == len((x.text or "").split()) and 0 <= x.copies <= 3
        by[x.source].append(x)
    expected = brute_targets({s: sum(x.size for x in v) for s, v in by.items()}, (1, 2, 3), 3)
    for s, v in by.items():
        assert abs(v[0].target - expected[s]) < 1e-6 * expected[s] and abs(sum(x.copies * x.size for x in v) - v[0].target) <= 15
    again = mixing.mix(df.repartition(7), "doc_id", "source", words(F.col("text"))).collect()
    assert {x.doc_id: x.copies for x in again} == {x.doc_id: x.copies for x in got}
    taken = Counter(x.doc_id for x in mixing.mix_documents(df).collect())
    assert taken == Counter({x.doc_id: x.copies for x in got if x.copies})
    assert mixing.mix(df.limit(0), "doc_id", "source", words(F.col("text"))).count() == 0


def test_mix_query_against_its_contract(spark, tmp_path):
    """Every column of op7, on the test tables and on few documents of very different sizes."""
    from askframe.llm.queries import op7_mixing

    r = random.Random(11)
    rows = [(i, " ".join(["w"] * int(10 ** r.uniform(0, 4))), r.choice(["a", "b", "c", "é", None])) for i in range(150)] + [(None, None, "a"), (7, "x y", "empty"), (8, None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (SF, "/root/testdata/sf0.01", str(tmp_path)):
        got = op7_mixing(spark, sf).collect()
        docs = table(spark, sf, "documents").collect()
        size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
        assert Counter((x.doc_id, x.source, x.size) for x in got) == Counter((d.doc_id, d.source, size(d.text)) for d in docs)
        by = defaultdict(list)
        for x in got:
            by[x.source].append(x)
        expected = brute_targets({s: sum(x.size for x in v) for s, v in by.items()}, (1, 2, 3), 3)
        for s, v in by.items():
            whole = sum(x.size for x in v)
            assert all(x.source_size == whole and abs(x.target - expected[s]) < 1e-6 * max(1, expected[s]) and x.taken % max(1, x.size) == 0 and x.taken <= 3 * x.size for x in v)
            assert abs(sum(x.taken for x in v) - expected[s]) <= max(x.size for x in v) / 2
        again = op7_mixing(spark, sf).collect()
        assert Counter((x.doc_id, x.source, x.size, x.taken) for x in got) == Counter((x.doc_id, x.source, x.size, x.taken) for x in again)


def test_mix_of_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 8)
    df = spark.createDataFrame([(None, "a b", "s")] * 300 + [(i, "a b", "s") for i in range(100)] + [(i, "c", "t") for i in range(500)], "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.source, r.copies) for r in mixing.mix(df, "doc_id", "source", words(F.col("text"))).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 900
    taken = Counter()
    for (_, source, copies), n in runs[0].items():
        taken[source] += n * copies * (2 if source == "s" else 1)
    goal = brute_targets({"s": 800, "t": 500}, (1, 2, 3), 3)
    assert all(abs(taken[k] - goal[k]) <= 2 for k in goal)


def test_mix_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 10 + [(None, None, None)] * 3, "doc_id long, text string, source string")
    got = mixing.mix(df, "doc_id", "source", words(F.col("text"))).collect()
    assert sorted((str(r.source), r.copies) for r in got) == [("None", 0)] * 3 + [("s", 1)] * 10
    more = df.unionByName(spark.createDataFrame([(i, "c d e", "t") for i in range(2, 9)], df.schema))
    expected = Counter()
    for r in mixing.mix(more, "doc_id", "source", words(F.col("text"))).collect():
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mix_documents(more).collect()) == Counter({k: v for k, v in expected.items() if v}) and expected[1] != 10


# -- WARC ----------------------------------------------------------------------------------------------------------------


def test_archive_round_trip():
    pages = [(i, f"http://x/{i}", f"<html>{'é' * i} page {i}</html>".encode()) for i in range(40)] + [(-1, None, b""), (None, "http://a b\r\n", b"\r\n\r\nWARC/1.1\r\n")]
    data = warc.archive([warc.record(*p) for p in pages])
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")  # a dictionary leads
    got = list(warc.read_archive(data))
    assert [g["payload"] for g in got] == [p[2] for p in pages] and [g["record_id"] for g in got] == [f"<urn:page:{'null' if p[0] is None else p[0]}>" for p in pages]
    small = warc.archive([warc.record(1, "http://x", b"p")])
    assert small[:4] != data[:4] and next(warc.read_archive(small))["payload_bytes"] == 1


@pytest.mark.parametrize(
    "change, said",
    [(lambda b: b.replace(b"Content-Length: 9", b"Content-Length: 8", 1), "payload"), (lambda b: b[:-4], "block"), (lambda b: b.replace(b"WARC-Date", b"WARC-Dote"), "warc-date"), (lambda b: b.replace(b"some page", b"same page"), "digest"), (lambda b: b.replace(b"WARC/1.1", b"HTTP/1.1"), "not a WARC"), (lambda b: b.replace(b"WARC-Type: ", b"WARC-Type "), "not a header")],
)
def test_faults_are_found(change, said):
    good = warc.record(1, "http://x", b"some page")
    with pytest.raises(ValueError, match=said):
        list(warc.read_archive(warc.archive([change(good)])))


def with_http(http, payload, digest_=None, kind="response", content="application/http"):
    block = http + payload
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x:1>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Type: {content}", *([f"WARC-Payload-Digest: {digest_}"] if digest_ else []), f"content-length:{len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_valid_archives_of_other_writers_are_read():
    sha = "sha1:" + warc.digest(b"hello")
    records = [
        with_http(b"HTTP/1.1 200 OK\r\ncontent-length:5\r\n\r\n", b"hello", sha),
        with_http(b"HTTP/1.0 200\r\nServer:x\r\n\r\n", b"hello"),
        with_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", b"3;x=1\r\nhel\r\n2\r\nlo\r\n0\r\n\r\n", sha),
        with_http(b"HTTP/1.1 200 OK\r\nX-Long: a\r\n b\r\nCONTENT-LENGTH: 5\r\n\r\n", b"hello", "sha256:" + hashlib.sha256(b"hello").hexdigest()),
        with_http(b"HTTP/1.1 200 OK\r\n\r\n", b"hello", "crc:1"),
    ]
    got = list(warc.read_archive(warc.archive(records)))
    assert [(g["payload"], g["payload_bytes"]) for g in got] == [(b"hello", 5)] * 5 and got[1]["payload_digest"] == warc.digest(b"hello")
    other = list(warc.read_archive(warc.archive([with_http(b"a: b\r\n", b"", kind="warcinfo", content="application/warc-fields"), with_http(b"anything", b"", kind="response", content="text/dns")])))
    assert [g["payload"] for g in other] == [None, None]
    for bad, said in ((with_http(b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n", b"hello"), "not a length"), (with_http(b"HTTP/1.1 200 OK\r\nno colon\r\n\r\n", b"hello"), "byte 0: not a header"), (with_http(b"HTTP/1.1 200 OK\r\n\r\n", b"hellO", sha), "digest")):
        with pytest.raises(ValueError, match=said):
            list(warc.read_archive(warc.archive([bad])))


def test_reading_takes_time_in_proportion_to_records(monkeypatch):
    """What the frames are fed: some steps each, not the rest of the archive."""
    fed = []
    real = warc.zstandard.ZstdDecompressor

    class Counting:
        def __init__(self, **k):
            self.inner = real(**k)

        def decompress(self, *a):
            return self.inner.decompress(*a)

        def decompressobj(self):
            one = self.inner.decompressobj()

            class Feed:
                eof = property(lambda _: one.eof)
                unused_data = property(lambda _: one.unused_data)

                def decompress(self, b):
                    fed.append(len(b))
                    return one.decompress(b)

            return Feed()

    r = random.Random(3)
    records = [warc.record(i, "u", r.randbytes(r.choice([10, 1000, 9000]))) for i in range(400)]
    small, large = warc.archive(records[:100]), warc.archive(records)
    monkeypatch.setattr(warc.zstandard, "ZstdDecompressor", Counting)
    totals = []
    for data in (small, large):
        fed.clear()
        assert len(list(warc.read_archive(data))) == (100 if data is small else 400)
        totals.append(sum(fed))
    assert totals[1] < 6 * totals[0]


def test_broken_frames():
    data = warc.archive([warc.record(i, "u", b"p" * 50) for i in range(9)])
    with pytest.raises(ValueError, match="cut off|not a frame"):
        list(warc.read_archive(data[:-3]))
    with pytest.raises(ValueError, match="not a frame"):
        list(warc.read_archive(data + b"junk junk"))


def test_warc_query_and_revisits(spark, tmp_path):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (5, "u5", "same"), (7, "u7", None), (8, "u8", ""), (9, "u9", "Füße" * 1000), (None, "n", "other")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op8_warc(spark, str(tmp_path)).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {1: ("revisit", 5), 3: ("revisit", 5), 7: ("revisit", 8)}
    assert got == sorted(((i, len((t or "").encode()), sha(t), *kind.get(i, ("response", None))) for i, _, t in rows), key=str)
    assert warc.round_trip(spark.read.parquet(f"{tmp_path}/pages.parquet").limit(0)).count() == 0
    # archives are ordinary files for Spark's binary reader too
    a = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet")).first()
    (tmp_path / "a.warc.zst").write_bytes(a.content)
    assert warc.read_archives(spark.read.format("binaryFile").load(f"{tmp_path}/a.warc.zst"), "path").count() == a.n_records


# -- resharding ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7), st.integers(1, 7))
def test_transfers_move_the_fewest_bytes(sizes, shards):
    old = dict(enumerate(sizes))
    total = sum(sizes)
    new = {s: (total + shards - 1 - s) // shards for s in range(shards)}
    blocks = resharding.transfers(old, new)
    out, into = Counter(), Counter()
    for a, b, n in blocks:
        assert n > 0
        out[a] += n
        into[b] += n
    assert all(out[s] == n for s, n in old.items()) and all(into[s] <= n for s, n in new.items())
    least = sum(max(0, n - new.get(s, 0)) for s, n in old.items())
    assert sum(n for a, b, n in blocks if a != b) == least


def test_min_cost_flow_with_costs():
    # two ways of cost 1 and 3; the cheap one holds 2 of 3 units
    arcs = [(0, 1, 5, 0), (1, 2, 2, 1), (1, 3, 5, 3), (2, 4, 5, 0), (3, 4, 5, 0), (4, 5, 3, 0)]
    assert resharding.min_cost_flow(6, arcs, 0, 5) == [3, 2, 1, 2, 1, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7), st.integers(0, 200))
def test_level(loads, fill):
    got = resharding.level(loads, fill)
    full = [a + b for a, b in zip(loads, got)]
    assert sum(got) == fill and min(got) >= 0 and all(f <= min(full) + 1 for f, g in zip(full, got) if g)


def test_reshard_and_rewrite(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.randint(1, 200), i % 3 if i % 2 else 0, "x") for i in range(900)] + [(None, 5, 1, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, bytes long, home int, slot string")
    x = written(resharding.reshard(df, "doc_id", F.col("home"), F.col("bytes"), 4))
    got = x.collect()
    total, shard = sum(b for _, b, _, _ in rows), Counter()
    slots = defaultdict(list)
    for g in got:
        shard[g.shard] += g.size
        slots[g.shard].append(g.slot)
    assert len(got) == len(rows) and max(shard.values()) - min(shard.values()) <= 200 and len(shard) == 4
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    moved = sum(g.size for g in got if g.shard != g.old_shard)
    homes = Counter()
    for _, b, h, _ in rows:
        homes[h] += b
    assert moved <= sum(max(0, n - total // 4) for n in homes.values()) + 400
    old = resharding.write_shards(x.drop("shard").withColumnRenamed("old_shard", "shard"), f"{tmp_path}/old")
    assert set(old) == {0, 1, 2}
    new = resharding.rewrite_affected(x, old, f"{tmp_path}/new")
    back = resharding.read_shards(x, new).groupBy("shard").agg(F.sum("size"), F.count("*")).collect()
    assert {b[0]: b[1] for b in back} == dict(shard)
    assert resharding.reshard(df.limit(0), "doc_id", F.col("home"), F.col("bytes"), 4).count() == 0


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    # shards 0 and 1 are right already, 2 is twice too large, 3 is empty
    rows = [(i, 10, 0 if i < 100 else 1 if i < 200 else 2) for i in range(400)]
    x = written(resharding.reshard(spark.createDataFrame(rows, "doc_id long, bytes long, home int"), "doc_id", F.col("home"), F.col("bytes"), 4))
    old = resharding.write_shards(x.drop("shard").withColumnRenamed("old_shard", "shard"), f"{tmp_path}/old")
    new = resharding.rewrite_affected(x, old, f"{tmp_path}/new")
    assert {s for s in new if new[s] == old.get(s)} == {0, 1} and set(new) == {0, 1, 2, 3}
    assert Counter(r.shard for r in resharding.read_shards(x, new).collect()) == {0: 100, 1: 100, 2: 100, 3: 100}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01", "hot"])
def test_reshard_query_against_its_contract(spark, tmp_path, sf):
    from askframe.llm.queries import op10_resharding

    if sf == "hot":  # a group larger than a shard, one nearly as large, nulls
        sf, r = str(tmp_path), random.Random(1)
        rows = [(i, "hot text " * 20, "n") for i in range(600)] + [(1000 + i, "warm " * 9, "n") for i in range(50)] + [(2000 + i, f"{i} é" * r.randint(0, 40), "n") for i in range(900)] + [(None, None, "n"), (5000, None, "n"), (5000, "", "n")]
        spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{sf}/documents.parquet")
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = op10_resharding(spark, sf).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((d.doc_id, len(raw(d.text)) + 16, zlib.crc32(raw(d.text))) for d in docs)
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    slots, size = defaultdict(list), Counter({s: 0 for s in range(40)})
    for x in got:
        slots[x.shard].append(x.slot)
        size[x.shard] += x.size
    assert set(size) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    units = defaultdict(lambda: [0, set()])
    for x in got:
        units[x.size, x.text_crc32][0] += x.size
        units[x.size, x.text_crc32][1].add(x.shard)
    capacity = -(-sum(size.values()) // 40)
    assert all(len(shards) == 1 for n, shards in units.values() if n <= capacity)
    largest = max(n for n, _ in units.values() if n <= capacity)
    assert max(size.values()) - min(size.values()) <= max(capacity / 50, largest)


# -- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text import brute_components, lower

    docs = table(spark, SF, "documents")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= set(before)
        if i < 4:
            assert out.columns == docs.columns and all(r == before[r.doc_id] for r in rows)
        if name == "exact dedup":
            assert ids == set({lower(r.text): k for k, r in sorted(before.items())}.values())
        elif name == "near dedup":
            order = sorted(before)
            comp = brute_components([before[k].text for k in order])
            assert ids == {order[c] for _, c in comp.values()}
        elif name == "toxicity":  # each text scored by itself, by the model's definition
            model = toxicity.fit(kept, table(spark, SF, "labels"))
            for r in before.values():
                terms = toxicity.hashed_terms(r.text or "")
                v = model.v[terms]
                margin = model.w0 + model.w[terms].sum() + ((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / 2
                assert abs(margin) < 1e-4 or (r.doc_id in ids) == (margin < 0)
        elif name == "mixing":
            size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
            by, taken = defaultdict(list), Counter()
            for r in before.values():
                by[r.source].append(size(r.text))
            for r in rows:
                taken[r.source] += size(r.text)
            goal = brute_targets({k: sum(v) for k, v in by.items()}, (1, 2, 3), 3)
            assert all(abs(taken[k] - goal[k]) <= max(v) / 2 for k, v in by.items()) and max(Counter(r.doc_id for r in rows).values()) <= 3
        elif name == "packing":
            tokenizer = packing.word_encoder(vocabulary("word_bpe_49k.json")).tokenizer
            expected = Counter()
            for r in kept.collect():  # a document that was taken twice is packed twice
                n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
                expected.update((r.doc_id, i, at, min(4096, n - at)) for i, at in enumerate(range(0, n, 4096)))
            assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == expected
            places = defaultdict(list)
            for r in rows:
                places[r.sequence_id].append((r.offset, r.length))
            for v in places.values():
                ends = np.cumsum([k for _, k in sorted(v)])
                assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 4096
        kept = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in every column, clashing names, repeated rows; then no rows at all."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (None, None, None, None, None, None), (None, "A b c d e f", None, None, 1, "y"), (2, "", "en", "s", 0, "z"), (3, long, "en", "t", 5, "z"), (4, long + " tail", "en", "t", 5, "z"), (5, None, "en", "t", 5, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for name, some in (("odd", rows), ("none", [])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = table(spark, path, "documents")
        for stage, f in corpus_pipeline.STAGES[:4]:
            out = f(spark, docs, path)
            assert out.columns == docs.columns, stage
            docs = written(out)
            if name == "none":
                assert docs.count() == 0
            elif stage == "exact dedup":  # equal texts stay once, with the largest id
                assert sorted(((r.doc_id, (r.text or "")[:9]) for r in docs.collect()), key=str) == sorted([(1, "a b c d e"), (3, "w0 w1 w2 "), (4, "w0 w1 w2 "), (5, "")], key=str)
            elif stage == "near dedup":
                assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 5]
        pieces = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in pieces} <= {1, 3, 5} and (name == "none") == (not pieces)
        assert all(r.offset + r.length <= 4096 for r in pieces)
