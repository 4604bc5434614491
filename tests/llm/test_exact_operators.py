"""Operators with an exact brute-force counterpart, on small fixtures with every kind of dirt."""

import random
from collections import Counter, defaultdict

import pytest
import regex

from tessera.llm.byte_bpe import DEFAULT_VOCABULARY, Encoder, texts_of, token_counts, token_ids
from tessera.llm.format_duplicates import canonical, collapsed, duplicate_rows, same_record
from tessera.llm.heavy_hitters import frequent_values
from tessera.llm.mixing import deviation, fill, mix, pfair
from tessera.llm.near_duplicates import EXPANDED_COPIES, banding, components, near_duplicate_groups, near_duplicate_pairs
from tessera.llm.pieces import oversized_pieces
from tessera.llm.repeated_lines import near_repeated_lines, repeated_lines, without_lines

DIRT = [None, "", "   ", "\n", "…", "a", "İstanbul ΑΣ ß ﬁ", "x" * 5000, "a b " * 3000, "​", "é́ e"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def triples(text, k=3):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return set(zip(*(words[i:] for i in range(k))))


def brute_pairs(rows, k, t):
    sets = [(i, s) for i, x in rows if x is not None and (s := triples(x, k))]
    return {
        (min(i, j), max(i, j))
        for n, (i, a) in enumerate(sets)
        for j, b in sets[n + 1 :]
        if len(a & b) >= t * len(a | b)
    }


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", ", ", "\n"]).join(words)))
            n += 1
    return rows + [(n + i, x) for i, x in enumerate(DIRT + DIRT)]


def test_near_duplicates_against_all_pairs(spark, edited):
    df = frame(spark, [(i, x, "clash", i) for i, x in edited], "id long, text string, node string, sig long")
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.6).collect()]
    assert len(got) == len(set(got))
    want = brute_pairs(edited, 3, 0.6)
    assert not set(got) - want
    assert len(set(got)) >= 0.98 * len(want)


def test_oversized_buckets_are_compared_in_blocks(edited, monkeypatch):
    """The blocks of an oversized bucket give the pairs that the bucket would."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import near_duplicates as nd

    texts = [(i, x) for i, x in edited if x and len(x.split()) > 2]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([x for _, x in texts])], names=["node", "text"])
    rows = next(nd._embed(3, *nd.banding(0.6))(iter([batch])))
    blobs = next(nd._scatter(1, nd.banding(0.6)[0])(iter([rows.select(["node", "vec", "sig"])])))

    def pairs():
        out = [b for x in nd._grid_join(0.6)(iter([blobs])) for b in nd._compare_blocks(0.6)(iter([x]))]
        return {tuple(p) for b in out for p in np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1).tolist()}

    whole = pairs()
    monkeypatch.setattr(nd, "LARGE_BUCKET", 2)
    monkeypatch.setattr(nd, "BLOCK", 2)
    assert len(whole) > 50 and pairs() == whole


def test_large_group_of_copies_is_a_star(spark):
    copies = EXPANDED_COPIES + 6
    rows = [(i, "one two three four five six") for i in range(copies)] + [(999, "one two three four five six seven")]
    got = {tuple(r) for r in near_duplicate_pairs(frame(spark, rows, "id long, text string"), "id", "text", shingle=3, threshold=0.6).collect()}
    assert got == {(0, i) for i in range(1, copies)} | {(0, 999)}


def test_every_pair_of_a_thousand_copies_on_demand(spark):
    rows = [(i, "one two three four five six") for i in range(1000)] + [(5000, "one two three four five six seven")]
    df = frame(spark, rows, "id long, text string")
    got = near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.6, expand=None)
    assert got.count() == got.distinct().count() == 1001 * 1000 // 2
    linear = near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.6)
    assert linear.count() == 1000
    groups = near_duplicate_groups(df, "id", "text", shingle=3, threshold=0.6).collect()
    assert len(groups) == 1001 and {(r.class_id, r.links) for r in groups} == {(0, 1000)}


def test_hot_band_keys_are_cut_into_blocks(spark, edited, monkeypatch):
    """With every counter hot, each two blocks of a key meet in a bucket of their own and no pair is lost."""
    from tessera.llm import near_duplicates as nd

    texts = [(i, x) for i, x in edited if x is not None]
    texts += [(9000 + i, "a b c d e f g h i j k l m n o p q r s t " + x) for i, x in enumerate("uvwxyzäöü")]  # alike to one another
    df = frame(spark, texts, "id long, text string")
    whole = {tuple(r) for r in near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.6).collect()}
    monkeypatch.setattr(nd, "HOT", 2)
    monkeypatch.setattr(nd, "HOT_SHARE", 0)
    monkeypatch.setattr(nd, "HOT_BLOCK", 2)
    embedded = df.select(df.id.alias("node"), "text").mapInArrow(nd._embed(3, *banding(0.6)), "node long, n int, vec binary, sig binary")
    blocks, entries = nd._hot_blocks(embedded, banding(0.6)[0])
    assert blocks.max() >= 5 and entries > embedded.count() * banding(0.6)[0]
    assert {tuple(r) for r in near_duplicate_pairs(df, "id", "text", shingle=3, threshold=0.6).collect()} == whole


def test_banding_follows_the_threshold():
    assert banding(0.6) == (64, 5) and banding(0.8) == (57, 11) and banding(1.0) == (1, 1)
    for t in (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9):
        bands, rows = banding(t)
        assert 1 - (1 - t**rows) ** bands >= 0.994


def test_near_duplicates_of_nothing(spark):
    empty = frame(spark, [], "id long, text string")
    assert near_duplicate_pairs(empty, "id", "text").count() == 0


def brute_groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(6)
    names = rng.sample(range(-5000, 5000), 900)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], x) for x in names[301:500]] + list(zip(names[500:600], names[501:600] + names[500:501]))
    edges += [(rng.choice(names[600:]), rng.choice(names[600:])) for _ in range(200)] + edges[:5]
    rng.shuffle(edges)
    got = [tuple(r) for r in components(frame(spark, edges, "node_a long, node_b long")).collect()]
    used = {n for a, b in edges if a != b for n in (a, b)}
    assert len(got) == len(used) and dict(got) == brute_groups(used, [e for e in edges if e[0] != e[1]])
    assert components(frame(spark, [], "node_a long, node_b long")).count() == 0


def test_groups_have_one_row_per_text_with_class_and_links(spark, edited):
    chain = [" ".join(f"c{j}" for j in range(i, i + 12)) for i in range(0, 12, 2)]  # neighbours alike, the ends not
    rows = edited + [(5000 + i, x) for i, x in enumerate(chain)] + [(6000 + i, "many copies of one text") for i in range(EXPANDED_COPIES + 6)]
    got = near_duplicate_groups(frame(spark, rows, "id long, text string"), "id", "text", shingle=3, threshold=0.6).collect()
    pairs = brute_pairs(rows, 3, 0.6)
    assert (5000, 5001) in pairs and (5000, 5005) not in pairs
    degree = Counter(x for p in pairs for x in p)
    assert len(got) == len(rows)
    groups = brute_groups([i for i, _ in rows], pairs)
    assert {r.id: (r.class_id, r.links) for r in got} == {i: (groups[i], degree[i]) for i, _ in rows}
    assert groups[5005] == 5000 and degree[6000] == EXPANDED_COPIES + 5
    assert near_duplicate_groups(frame(spark, [], "id long, text string"), "id", "text").count() == 0


FORMATS = [
    "law: Krok Act; topic: fee waiver", "Topic = FEE waiver |  law : krok act", "topic:fee waiver\nlaw:Krok Act", "law Krok Act topic fee waiver",
    "What is it?", "what is  IT", "WHATISIT!", "a; b", "b; a", "x: ; y: 2", "y: 2; x: ", "k: v", "k=v;", "k v", "a: 1; b: 2; c", "c; a: 1; b: 2",
]


def plain_canonical(text):
    squeeze = lambda s: "".join(c for c in s.lower() if c.isalnum())
    items = [p for p in regex.split(r"[;|\r\n]", text) if squeeze(p)]
    if len(items) > 1 and all(regex.match(r"\s*[^\W_]+\s*[:=].*[^\W_]", p, regex.S) for p in items):
        return "|".join(sorted(map(squeeze, items)))
    return squeeze(text)


def test_format_duplicates_against_plain_normalisation(spark):
    rows = list(enumerate(FORMATS + [x for x in DIRT if x != "İstanbul ΑΣ ß ﬁ"] + ["\t" + x + " !" for x in FORMATS] + DIRT))
    by = defaultdict(list)
    for i, x in rows:
        if x is not None and plain_canonical(x):
            by[plain_canonical(x)].append(i)
    df = frame(spark, [(i, x, "q") for i, x in rows], "id long, q string, text string")
    got = {r.row_id: r.norm_text for r in duplicate_rows(df, "id", "q").collect()}
    assert set(got) == {i for ids in by.values() if len(ids) > 1 for i in ids}
    assert all(got[i] == plain_canonical(dict(rows)[i]) for i in got)
    assert Counter(r.copies for r in collapsed(df, "id", "q").collect()) == Counter(map(len, by.values()))
    assert duplicate_rows(df.limit(0), "id", "q").count() == 0


def test_two_pointer_comparison():
    for a in FORMATS:
        for b in FORMATS:
            assert same_record(a, b) == (canonical(a) == canonical(b))


def test_records_that_share_all_hash_bits_are_kept_apart(spark, monkeypatch):
    """With hashes that tell nothing, and groups in slices, the results are those of the comparison alone."""
    import numpy as np

    from tessera.llm import format_duplicates as fd

    rows = [(i, x) for i, x in enumerate(FORMATS * 2 + ["only once", "and this", "b: 1; a: 2"])]
    want = defaultdict(list)
    for i, x in rows:
        if key := plain_canonical(x):
            want[key].append(i)
    df = frame(spark, rows, "id long, q string").coalesce(1)
    real = fd.record_hashes

    def same(texts):
        h1, _, filled = real(texts)
        return np.ones_like(h1), np.ones_like(h1), filled

    # the workers import the module anew, so the groups are run here over one ordered batch
    import pyarrow as pa

    filled = [(i, x) for i, x in rows if plain_canonical(x)]
    ones = pa.array([1] * len(filled), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in filled], pa.int64()), ones, ones, pa.array([0] * len(filled), pa.int32()), pa.array([x for _, x in filled])], names=["row_id", "h1", "h2", "slice", "text"])
    got = {r["row_id"]: r["norm_text"] for b in fd._confirm(pa.int64())(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()}
    assert got == {i: key for key, ids in want.items() if len(ids) > 1 for i in ids}
    kinds = [r for b in fd._tally(pa.int64())(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["first_id"], r["copies"]) for r in kinds) == sorted((min(ids), len(ids)) for ids in want.values())
    assert same(["a"])[2].all() and df.count() == len(rows)
    # a group in slices of two rows, some alone in theirs
    monkeypatch.setattr(fd, "SLICE", 2)
    assert {r.row_id for r in duplicate_rows(df, "id", "q").collect()} == set(got)
    assert Counter(r.copies for r in collapsed(df, "id", "q").collect()) == Counter(map(len, want.values()))
    monkeypatch.setattr(fd, "FEW_KEYS", 0)
    assert {r.row_id for r in duplicate_rows(df, "id", "q").collect()} == set(got)


def test_buckets_follow_the_share(spark, monkeypatch):
    from tessera.llm import heavy_hitters as hh

    assert hh.buckets_for(0.005) == 14 and hh.buckets_for(1e-5) == 20 and hh.buckets_for(1e-9) == 21
    rng = random.Random(5)
    values = [f"v{int(rng.paretovariate(0.4))}" for _ in range(20_000)]
    df = frame(spark, [(v,) for v in values], "v string")
    want = {k: n for k, n in Counter(values).items() if n >= 4}
    assert {r.value: r.n for r in frequent_values(df, "v", share=0.0002).collect()} == want
    monkeypatch.setattr(hh, "LITERALS", 5)
    assert {r.value: r.n for r in frequent_values(df, "v", share=0.0002).collect()} == want


def test_frequent_values_are_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([" hot\n", "hot", "warm", None, "  "]) if rng.random() < 0.5 else f"cold {rng.randrange(3000)}" for _ in range(4000)]
    df = frame(spark, [(v, 1) for v in values], "v string, h long")
    want = {k: n for k, n in Counter(v.strip() for v in values if v and v.strip()).items() if n >= 0.005 * len(values)}
    assert {r.value: r.n for r in frequent_values(df, "v", share=0.005).collect()} == want
    assert frequent_values(df.limit(0), "v", share=0.5).count() == 0


def test_repeated_lines(spark):
    rows = [(i, "site", f"Body {i}\n Share  THIS page \n\nshare this page") for i in range(6)]
    rows += [(10 + i, "other", "Share this page") for i in range(4)] + [(20, None, "Share this page"), (21, " ", "x"), (22, "site", None)]
    df = frame(spark, [(i, s, x, "z") for i, s, x in rows], "id long, src string, body string, source string")
    found = repeated_lines(df, "id", "src", "body")
    assert {(r.id, r.line_no) for r in found.collect()} == {(i, k) for i in range(6) for k in (1, 3)}
    clean = {r.id: r.body for r in without_lines(df, found, "id", "body").collect()}
    assert len(clean) == len(rows) and clean[0] == "Body 0\n" and clean[10] == "Share this page" and clean[22] is None
    assert repeated_lines(df.limit(0), "id", "src", "body").count() == 0


def test_lines_that_differ_in_numbers_are_one_cluster(spark):
    rows = [(i, "site", f"Body of chunk {i} about the matter {i * 7}\nRead {i} more notes of 2{i} May\nkept line") for i in range(8)]
    rows += [(50 + i, "other", f"Read {i} more notes of 2{i} May") for i in range(3)] + [(60, None, "Read 1 more notes"), (61, "site", None)]
    df = frame(spark, [(i, s, x, "z") for i, s, x in rows], "id long, src string, body string, h string")
    near = near_repeated_lines(df, "id", "src", "body")
    got = {(r.id, r.line_no): r.docs_with_line for r in near.collect()}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in range(8)} and got[0, 1] == 8 and (50, 0) not in got
    assert {(r.id, r.line_no) for r in repeated_lines(df, "id", "src", "body").collect()} == {(i, 2) for i in range(8)} <= set(got)
    clean = {r.id: r.body for r in without_lines(df, near, "id", "body").collect()}
    assert "Read" not in clean[3] and "kept line" not in clean[3] and clean[50] == "Read 0 more notes of 20 May" and clean[61] is None
    assert near_repeated_lines(df.limit(0), "id", "src", "body").count() == 0


@pytest.mark.parametrize("limit,overlap", [(400, 80), (20, 5), (7, 0)])
def test_pieces_cover_the_text(spark, limit, overlap):
    rng = random.Random(2)
    texts = ["w " * 950, "One. " * 700, "\n".join("word " * 13 for _ in range(90)), "x y　z" * 300, "a b c"] + [
        " ".join(rng.choice(["go", "stop.", "end!\n", "x,"]) for _ in range(rng.randrange(1, 1500))) for _ in range(8)
    ]
    rows = list(enumerate(texts)) + [(100 + i, x) for i, x in enumerate(DIRT)]
    df = frame(spark, [(i, x, 3) for i, x in rows], "id long, body string, words long")
    got = defaultdict(list)
    for r in oversized_pieces(df, "id", "body", limit=limit, overlap=overlap).orderBy("id", "piece_no").collect():
        got[r.id].append(r)
    assert set(got) == {i for i, x in rows if x and len(x.split()) > limit}
    for i, pieces in got.items():
        words = dict(rows)[i].split()
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        assert all(len(p.piece.split()) == p.words <= limit and p.overlap <= overlap for p in pieces)
        assert [w for p in pieces for w in p.piece.split()[p.overlap :]] == words
    assert got[0][0].words == limit  # no boundary: a hard cut


def test_pieces_end_at_sentences(spark):
    df = frame(spark, [(1, ("aa " * 9 + "bb. ") * 60)], "id long, body string")
    pieces = oversized_pieces(df, "id", "body").collect()
    assert all(p.piece.endswith("bb.") and p.piece.startswith("aa") for p in pieces)


def test_token_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    texts = DIRT + ["Hello  world's\r\n\tfine 1234½ <|endoftext|>", "日本語のテキスト。 Ελληνικά", "👩‍⚕️ 🏥 ＦＵＬＬ１２ x²", "we'll I'M don't"]
    df = frame(spark, list(enumerate(texts)), "id long, ids string")
    got = {r.id: r.ids for r in token_ids(df, "id", "ids").collect()}
    encoder = Encoder(open(DEFAULT_VOCABULARY, "rb").read())
    for i, x in enumerate(texts):
        assert got[i] == (library.encode(x, add_special_tokens=False).ids if x else [])
        assert not x or encoder.decode(got[i]) == x
    back = {r.id: r.text for r in texts_of(token_ids(df, "id", "ids"), "id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert texts_of(frame(spark, [(1, None)], "id long, ids array<int>"), "id", "ids").first().text is None
    counted = token_counts(df.withColumnRenamed("ids", "t"), ["id"], "t")
    assert {r.id: r.tokens for r in counted.collect()} == {i: len(v) for i, v in got.items()}


def test_filling_and_schedule():
    assert fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 500}) == {"a": 10, "b": 90}
    assert fill(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert fill(100, {"a": 0, "b": 1}, {"a": 9, "b": 0}) == {"a": 0, "b": 0}
    blocks = {"a": 50, "b": 30, "c": 15, "d": 5}
    order = pfair(blocks)
    assert Counter(s for s, _ in order) == blocks
    seen = Counter()
    for t, (s, j) in enumerate(order, 1):
        assert seen[s] == j
        seen[s] += 1
        assert all(abs(seen[x] - t * n / 100) < 1 for x, n in blocks.items())


def test_mix_reaches_its_shares(spark):
    rows = [(i, "big", "tok " * 50) for i in range(200)] + [(1000 + i, "small", "tok " * 50) for i in range(10)]
    rows += [(2000, None, "tok " * 50), (2001, "extra", "x"), (2002, "big", None), (2003, "big", "")]
    df = frame(spark, [(i, s, x, 1) for i, s, x in rows], "id long, src string, text string, tokens long")
    targets = frame(spark, [("big", 0.7, 2), ("small", 0.3, 3), ("absent", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mix(df, targets, "id", "src", "text", blocks=50)
    rows = drawn.collect()
    assert len({(r.id, r.repeat) for r in rows}) == len(rows)
    assert max(r.repeat for r in rows if r.source == "small") == 2
    by = {r.source: r for r in shares.collect()}
    assert by["small"].drawn_tokens == 3 * by["small"].available_tokens and by["absent"].drawn_tokens == 0
    total = token_counts(df, ["id"], "text").agg({"tokens": "sum"}).first()[0]
    assert abs(sum(r.drawn_tokens for r in by.values()) - total) <= 51
    off = {r.source: r for r in deviation(drawn).collect()}
    # a block holds three or four of these documents, so its size varies by a third at most
    assert set(off) == {"big", "small"} and all(r.blocks < 1.5 for r in off.values()) and abs(sum(r.actual_share for r in off.values()) - 1) < 1e-9
    assert mix(df.limit(0), targets, "id", "src", "text")[0].count() == 0 and deviation(drawn.limit(0)).count() == 0
