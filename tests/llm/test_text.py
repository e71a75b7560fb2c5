"""Token counts, packing, exact dedup, n-gram join, toxicity."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askframe.llm import exact_dedup, ngram_join, packing, token_counts, toxicity
from askframe.llm.common import LOWER, UPPER, written
from askframe.llm.queries import vocabulary

TEXTS = [None, "", "   ", "one", "Füße <|endoftext|> don't\n\nstop.", "a b c d e", "A b C d e f", "long " * 5000, "x" * 3000, "日本語 text, Ünïcode! é", "same same", "Same Same", "SAME SAME", "ÉCLAIR", "éclair", "tab\tand\x0bvt"]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", "src", i, i, "x") for i, t in enumerate(texts)]
    # extra columns whose names are those of helpers
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, length long, bucket string")


def lower(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


# -- token counts --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text("ab é.\n日!", max_size=40))
def test_sections_cover_the_text(text):
    found = token_counts.parts(text)
    assert "".join(text[a:b] for _, a, b in found) == text and all(a < b for _, a, b in found)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_match_brute_force(spark, rule):
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts.byte_encoder(path)
    assert isinstance(encoder, tiktoken.Encoding)
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs_of(spark, TEXTS), "doc_id", "text", path, rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.kind, r.start, r.end, r.n_tokens))
        assert r.n_crossing >= 0
    for i, t in enumerate(TEXTS):
        if not t:
            assert got[i] == [("empty", 0, 0, 0)]
            continue
        # the owner of every byte, then of every token
        owner = [k for k, (_, a, b) in enumerate(token_counts.parts(t)) for _ in t[a:b].encode()]
        n, at = Counter(), 0
        for token in encoder.encode_ordinary(t):
            own = owner[at : at + len(encoder.decode_single_token_bytes(token))]
            at += len(own)
            n[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
        assert got[i] == [(kind, a, b, n[k]) for k, (kind, a, b) in enumerate(token_counts.parts(t))]


def test_very_long_blank_runs(spark, monkeypatch):
    path = vocabulary("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts.byte_encoder(path)
    r = random.Random(4)
    import re as re_

    with monkeypatch.context() as m:  # short runs, so that the tokenizer itself can say what is right
        m.setattr(token_counts, "LONG_RUN", 5)
        m.setattr(token_counts, "BLANKS", re_.compile(token_counts.BLANKS.pattern.replace("50000", "5")))
        for _ in range(3000):
            text = "".join(r.choice(["a", "b1", " ", "  ", "\n", "\t", "      ", "\u3000", "\x85\xa0", "'s", "!", "é", "\x1c"]) for _ in range(r.randint(1, 25)))
            assert token_counts.encode(encoder, text).tolist() == encoder.encode_ordinary(text), repr(text)
    rows = [(None, "a"), (1, " " * 1_000_000), (1, "a. b" + " \n" * 400_000 + "c"), (2, "x" * 200_000)]
    got = token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", path, "most").collect()
    assert Counter(r.doc_id for r in got)[1] >= 3 and sum(r.n_tokens for r in got if r.doc_id == 1 and r.doc_tokens == 1_000_000) == 1_000_000
    assert [(r.n_tokens, r.doc_tokens) for r in got if r.doc_id is None] == [(1, 1)]


def test_token_counts_query(spark):
    """Every column of op1 over its table."""
    from askframe.llm.queries import op1_token_counts, table

    encoder, _ = token_counts.byte_encoder(vocabulary("byte_bpe_50k.tiktoken"))
    got = defaultdict(list)
    for r in op1_token_counts(spark, "/root/testdata/sf0.001").orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        text, own = d.text or "", got[d.doc_id]
        ids = encoder.encode_ordinary(text)
        found = token_counts.parts(text) or [("empty", 0, 0)]
        assert [(r.section, r.kind, r.start, r.end) for r in own] == [(i, *p) for i, p in enumerate(found)]
        assert all(r.doc_tokens == len(ids) for r in own)
        ends = [len(text[:b].encode()) for _, _, b in found]
        n, crossing, at = [0] * len(own), [0] * len(own), 0
        for token in ids:
            size = len(encoder.decode_single_token_bytes(token))
            shares = [max(0, min(e, at + size) - max(b, at)) for b, e in zip([0, *ends], ends)]
            n[shares.index(max(shares))] += 1
            touched = [i for i, x in enumerate(shares) if x]
            crossing[touched[-1]] += len(touched) > 1
            at += size
        assert [(r.n_tokens, r.n_crossing) for r in own] == list(zip(n, crossing))


def test_packing_query(spark):
    """Every column of op6 over its table, and the number of sequences against the bound."""
    from askframe.llm.queries import op6_packing, table

    sf = "/root/testdata/sf0.01"
    tokenizer = packing.word_encoder(vocabulary("word_bpe_49k.json")).tokenizer
    expected = {}
    for d in table(spark, sf, "documents").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i, at in enumerate(range(0, len(ids), 4096)):
            expected[d.doc_id, i] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    places, got = defaultdict(list), {}
    for r in op6_packing(spark, sf).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        places[r.sequence_id].append((r.offset, r.length))
    assert got == expected and sum(map(len, places.values())) == len(expected)
    for v in places.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) <= -(-sum(n for _, n, _ in expected.values()) // 4096) + 1


def test_section_tokens_rules_and_empty(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs_of(spark, ["a"]), "doc_id", "text", path, "none")
    assert token_counts.section_tokens(docs_of(spark, ["a"]).limit(0), "doc_id", "text", path).count() == 0


# -- packing -------------------------------------------------------------------------------------------------------------


def test_word_encoder_is_the_tokenizer():
    e = packing.word_encoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(3)
    letters = "aAbzZéÉßÿ×÷ .,!?'<>|_-0129\n\t½ªµ́ İΣσ"
    for text in [*(t for t in TEXTS if t), "İSTANBUL ΣΑΣ", "x_y__z a1b22 ½²", "a\x85c\x1cd", "<|startoftext|>y", *("".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(3000))]:
        assert e.encode(text) == e.whole(text), repr(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_packing_holds_everything(counts):
    found = packing.pack(counts, 64)
    assert all(sum(k * n for k, n in items) <= 64 for _, items in found)
    held = Counter()
    for n, items in found:
        for k, times in items:
            held[k] += n * times
    assert dict(held) == counts
    # no two sequences would fit into one
    fills = sorted(sum(k * times for k, times in items) for n, items in found for _ in range(n))
    assert len(fills) < 2 or fills[0] + fills[1] > 64


def exact_bins(items, window):
    """Fewest bins by trying everything."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= window:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_packing_is_near_the_least():
    r = random.Random(1)
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(9)), reverse=True)
        assert sum(n for n, _ in packing.pack(dict(Counter(items)), 24)) <= exact_bins(items, 24)


def test_pack_documents(spark):
    docs = docs_of(spark, [*TEXTS, "same same"])
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated row
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, 512).collect()
    e = packing.word_encoder(path)
    ids = {i: np.frombuffer(e.whole(t or ""), dtype="<u4").tolist() + [1] for i, t in enumerate([*TEXTS, "same same"])}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.start == r.piece * 512 and r.ids_crc32 == zlib.crc32(part.tobytes())
        pieces[r.doc_id].append(r.length)
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(pieces[3]) == 2 * len(ids[3]) and all(sum(v) == len(ids[k]) for k, v in pieces.items() if k != 3)
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(docs.limit(0), path, 512).count() == 0


# -- exact dedup ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep, best", [("max", max), ("min", min)])
def test_exact_dedup_matches_brute_force(spark, keep, best):
    texts = [*TEXTS, *["Hot Text", "hot text"] * 40, *TEXTS]
    docs = docs_of(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, "doc_id", "text", keep, hot=8).collect()}
    assert got == {i: (best(groups[lower(t)]), len(groups[lower(t)]), i == best(groups[lower(t)])) for i, t in enumerate(texts)}


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "A"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 512):
        for keep in ("min", "max"):
            out = exact_dedup.exact_dedup(docs, "doc_id", "text", keep, hot).collect()
            assert Counter((r.text_sha256, r.kept) for r in out if r.kept).most_common(1)[0][1] == 1 and sum(r.kept for r in out) == 3
            assert {r.keep_id for r in out if r.group_size == 2} == ({2, None} if keep == "max" else {None})
    stay = exact_dedup.drop_copies(docs, "doc_id", "text", "max")
    assert stay.columns == docs.columns and Counter(lower(r.text) for r in stay.collect()) == Counter("abc")
    assert exact_dedup.exact_dedup(docs.limit(0), "doc_id", "text").count() == 0


def test_drop_copies(spark):
    docs = docs_of(spark, TEXTS)
    kept = exact_dedup.drop_copies(docs, "doc_id", "text", "max").collect()
    last = {lower(t): i for i, t in enumerate(TEXTS)}
    assert sorted(r.doc_id for r in kept) == sorted(last.values()) and all(r.text == TEXTS[r.doc_id] for r in kept)


# -- n-gram join ---------------------------------------------------------------------------------------------------------


def brute_components(texts, n=5, percent=75):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_texts():
    r = random.Random(5)
    out = list(TEXTS)
    vocabulary_ = [f"w{i}" for i in range(60)]
    passage = " ".join(r.choice(vocabulary_) for _ in range(30))
    for k in range(12):
        base = [r.choice(vocabulary_) for _ in range(r.choice([6, 20, 60, 120]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary_)
            out.append(" ".join(copy) + (f" {passage}" if k % 3 == 0 else ""))
    # a chain: each shares three quarters with the next
    words = [f"c{i}" for i in range(120)]
    out += [" ".join(words[4 * i : 4 * i + 64]) for i in range(12)]
    r.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, texts), "doc_id", "text").collect()}
    expected = brute_components(texts)
    assert got == expected and len({c for _, c in expected.values()}) < len(texts)


@pytest.mark.parametrize("base_first", [True, False])
def test_near_copies_of_one_text_give_few_pairs(spark, monkeypatch, base_first):
    """Copies that are like their base but not like one another: pairs follow the rows, wherever the base's id lies."""
    n_pairs = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: n_pairs.append(pairs.count()) or real(pairs, *a))
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(240):
        copy = list(base)
        for k, j in enumerate(r.sample(range(120), 3 if i % 3 else 7)):  # two thirds link with the base, the others with nothing
            copy[j] = f"own{i}x{k}"
        copies.append(" ".join(copy))
    texts = [" ".join(base), *copies] if base_first else [*copies, " ".join(base)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs_of(spark, texts), "doc_id", "text").collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()} and len(set(got.values())) < 100
    assert sum(n_pairs) <= 4 * len(texts)


def test_rounds_of_pivots_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 0)  # pivots as long as they merge anything
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, texts), "doc_id", "text").collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert ngram_join.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0
    assert sorted(str(r.doc_id) for r in ngram_join.drop_near_duplicates(docs).collect()) == ["1", "1", "3", "None"]


def test_hot_shingles_are_passed_on(spark, monkeypatch):
    texts = near_texts()
    sketch = spark.sparkContext.broadcast(np.full(ngram_join.COUNTERS, 7, dtype=np.uint32))
    pre = written(ngram_join.prefixes(docs_of(spark, texts).select("doc_id", "text"), 5, 75, sketch)).selectExpr("doc_id AS gid", "prefix")
    normal = {tuple(r) for r in ngram_join.shared_postings(pre, 100, sketch).collect()}
    monkeypatch.setattr(ngram_join, "HOT_DOCS", -100)
    assert normal < {tuple(r) for r in ngram_join.shared_postings(pre, 100, sketch).collect()}


# -- toxicity ------------------------------------------------------------------------------------------------------------


def test_factorization_machine_learns_a_pair():
    """The label is true only where both words occur; weights alone cannot say that."""
    r = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(3000):
        a, b = r.random(2) < 0.5
        text = " ".join([f"n{r.integers(40)}" for _ in range(6)] + ["insult"] * int(a) + ["group"] * int(b))
        docs.append(toxicity.hashed_terms(text))
        labels.append(int(a and b))
    m = toxicity.FactorizationMachine.fit(docs[:2000], np.array(labels[:2000]))
    test = docs[2000:]
    s = m.scores(np.concatenate(test), np.concatenate([[0], np.cumsum([len(d) for d in test])]))
    assert ((s >= 0.5) == np.array(labels[2000:])).mean() > 0.97
    pair = m.v[toxicity.hashed_terms("insult")] @ m.v[toxicity.hashed_terms("group")].T
    assert pair.max() > 0.3  # the interaction itself was learned


def test_margins_match_the_definition():
    r = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(0.3, r.normal(size=50), r.normal(size=(50, 3)))
    docs = [np.array([1, 4, 9]), np.array([], dtype=int), np.array([7]), np.array([], dtype=int)]
    got = m.margins(np.concatenate(docs).astype(int), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    for g, d in zip(got, docs):
        pairs = sum(m.v[i] @ m.v[j] for k, i in enumerate(d) for j in d[:k])
        assert abs(g - (0.3 + m.w[d].sum() + pairs)) < 1e-9


def test_held_out_accuracy(spark):
    from askframe.llm.queries import op4_toxicity, table

    sf = "/root/testdata/sf0.1"
    x = op4_toxicity(spark, sf)
    assert x.count() == table(spark, sf, "documents").count()
    rows = x.join(table(spark, sf, "labels"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.01
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, TEXTS)
    labels = spark.createDataFrame([(None, 1), (4, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "score"] and all(r.score < 1e-6 for r in out.collect())
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.score(out, model).columns == out.columns
