"""The llm operators against brute force, round trips and SQL, and their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fotomill.llm import near_duplicates as near_duplicates_module
from fotomill.llm import queries
from fotomill.llm.components import components, group_links
from fotomill.llm.near_duplicates import Level, near_duplicate_pairs, near_duplicates, read_hash, similar_hashes
from fotomill.llm.packing import fill_containers, pack
from fotomill.llm.splitting import PARAGRAPH, SENTENCE, boundary_strengths, split_ids, split_texts
from fotomill.llm.survivorship import Ballot, Field, decayed, field_winners, group_of, merged_records, surviving_records
from fotomill.llm.tokens import SAFE, TOKENIZER, corpus_ids, encoder, with_token_counts
from tests.oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(connect(sf), queries.SQL[name])


# -- near duplicates ---------------------------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("weight, levels, block", [(16.0, (2, 3, 4, 5, 6, 7), 4000), (0.03, (2, 3, 4, 5, 6, 7), 4000), (1e-6, (2, 3), 7), (1e9, (4, 5), 50)])
def test_similar_hashes_at_every_prefix_length(spark, weight, levels, block):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    crowd = rng.getrandbits(64)  # a crowded region: most blocks alike
    hashes = set(base) | {crowd ^ rng.getrandbits(12) for _ in range(150)} | {0, 1, (1 << 64) - 1}
    for b in base:
        for _ in range(4):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << bit
            hashes.add(x)
    hs = sorted(hashes)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(hs) for b in hs[:i] if (a ^ b).bit_count() <= 5}
    df = spark.createDataFrame([(signed(h),) for h in hs], "hash long")
    got = [tuple(r) for r in similar_hashes(df, 5, weight, levels, block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_levels_cover_the_hash():
    for shared in (2, 3, 4, 5, 6, 7):
        blocks = Level(shared, 5).blocks
        assert sum(w for _, w in blocks) == 64 and blocks[0][0] == 0
        assert all(a + w == b for (a, w), (b, _) in zip(blocks, blocks[1:], strict=False))


def test_crowds_take_longer_prefixes_and_lose_nothing(spark):
    """With the production weights: three crowds of growing density among scattered hashes, which use three levels and more."""
    rng = random.Random(11)
    far = {rng.getrandbits(64) for _ in range(4000)}
    crowds = [{rng.getrandbits(64) >> k << k | rng.getrandbits(k) for _ in range(size)} for k, size in ((20, 3000), (26, 2500), (40, 2500))]
    for c, k in zip(crowds, (20, 26, 40), strict=True):
        top = rng.getrandbits(64) >> k << k
        c_fixed = {top | (h & ((1 << k) - 1)) for h in c}
        c.clear(), c.update(c_fixed)
    hs = np.array(sorted(far.union(*crowds)), np.uint64)
    want = set()
    for i in range(len(hs) - 1):
        for j in np.flatnonzero(np.bitwise_count(hs[i] ^ hs[i + 1 :]) <= 5):
            want.add(tuple(sorted((signed(int(hs[i])), signed(int(hs[i + 1 + j]))))))
    df = spark.createDataFrame([(signed(int(h)),) for h in hs], "hash long")
    seen, was = [], near_duplicates_module._meetings
    near_duplicates_module._meetings = lambda docs, n, level, bound: seen.append(level.shared) or was(docs, n, level, bound)
    try:
        got = [tuple(r) for r in similar_hashes(df, 5).collect()]
    finally:
        near_duplicates_module._meetings = was
    assert len(seen) >= 3 and seen == sorted(seen)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_copies_of_a_hot_hash_are_cut_into_chunks(spark):
    df = spark.range(2600).select("id", F.when(F.col("id") < 1200, "abc0").when(F.col("id") < 1203, "abc1").otherwise(F.hex(F.xxhash64("id"))).alias("h"))
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "h").collect()]
    assert len(got) == len(set(got)) == 1203 * 1202 // 2 and all(a < b < 1203 for a, b in got)


def test_read_hash(spark):
    cases = {
        "3a887cf5238d2f": 0x3A887CF5238D2F, "0X00B20A68C9F714FE": 0xB20A68C9F714FE, " 81e9-fa14-c06a-d2df ": signed(0x81E9FA14C06AD2DF),
        "003A887C F5238D2F": 0x3A887CF5238D2F, "0": None, "0000000000000000": None, "1": 1, "8888888888888888": None, "888888888888888": 0x888888888888888,
        "ffffffffffffffff": None, "error": None, "n/a": None, "": None, "0x": None, None: None, "12345678901234567": None, "f" * 100_000: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", read_hash(F.col("t")).alias("h")).collect()} == cases


def test_near_duplicate_edges(spark):
    rows = [(1, "00000000000000f0", 9), (1, "00000000000000f0", 9), (2, "F0", 9), (3, "00000000000000f1", 9), (None, "f0", 9), (4, None, 9), (5, "ffff0000ffff0000", 9)]
    df = spark.createDataFrame(rows, "id long, h string, hash int")
    assert sorted(tuple(r) for r in near_duplicate_pairs(df, "id", "h").collect()) == [(1, 2), (1, 3), (2, 3)]
    assert near_duplicate_pairs(df.limit(0), "id", "h").count() == 0
    copies = spark.range(3000).select("id", F.when(F.col("id") < 1000, "abc0").otherwise(F.hex(F.xxhash64("id"))).alias("h"))
    members, links = near_duplicates(copies, "id", "h")
    assert members.count() == 3000 and members.select("hash").distinct().count() == 2001 and links.count() < 5


# -- survivorship ------------------------------------------------------------------------------------------------------


def test_votes_choose_the_value(spark):
    rows = [
        ("G ", 1, 5.0, 2.0, 0), (" g", 2, 7.0, 1.0, 0), ("g", 3, 7.0, 1.0, 0), ("g", 3, 7.0, 1.0, 0), ("g", 4, float("nan"), 9.0, 0), ("g", 5, None, 9.0, 0),
        ("h", 6, 1.0, 1.0, 400), ("h", 7, 2.0, 1.0, 0), (None, 8, 3.0, 1.0, 0), (" ", 9, 3.0, 1.0, 0), ("g", None, 99.0, 99.0, 0),
    ]
    df = spark.createDataFrame(rows, "grp string, id long, v double, trust double, age int").withColumn("value", F.lit("clash"))
    f = [Field("v", ~F.isnan("v"), ballots=[Ballot(F.col("trust"), decayed(F.col("age"), 100.0))])]
    won = {r["grp"]: (r["v"]["value"], round(r["v"]["votes"][0], 6), r["v"]["record_id"], r["records"]) for r in field_winners(df, group_of("grp"), "id", f).collect()}
    assert won == {"g": (5.0, 2.0, 1, 2), "h": (2.0, 1.0, 7, 2)}  # g: 2 votes each, the least record
    assert {r["grp"]: r["v"] for r in merged_records(field_winners(df, group_of("grp"), "id", f), f).collect()} == {"g": 5.0, "h": 2.0}
    own = [Field("v", ~F.isnan("v"), by_record=True, ballots=[Ballot(F.col("v"))]), Field("r", F.lit(True), F.lit(0.0), True, [Ballot(F.lit(1)), Ballot(F.col("v"), level=1, when=~F.isnan("v"))])]
    rows = surviving_records(field_winners(df, group_of("grp"), "id", own), own)
    assert {tuple(r) for r in rows.collect()} == {("g", "v", 2), ("g", "r", 2), ("h", "v", 7), ("h", "r", 7)}
    assert field_winners(df.limit(0), group_of("grp"), "id", f).count() == 0
    alone = df.filter("id = 6")
    assert surviving_records(field_winners(alone, group_of("grp"), "id", own), own).count() == 0


# -- components --------------------------------------------------------------------------------------------------------


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_random_chain_and_star(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    rng.shuffle(chain)
    pairs = chain + [(5000, 5001 + i) for i in range(2000)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    pairs += [(7, 7), (None, 3), (3, None), (1001, 1000), chain[0], (-5, 10_000), (10_000, 10_001)]
    df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a long, b long, big int")
    got = components(df, "a", "b").collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute_components(pairs)
    assert components(df.limit(0), "a", "b").count() == 0


def test_group_links_are_stars(spark):
    df = spark.createDataFrame([(i, "x") for i in range(3000)] + [(1, "y"), (None, "y"), (4, None), (9, "z"), (2, "z"), (9, "z")], "id long, g string")
    got = group_links(df, "id", group_of("g")).collect()
    assert len(got) == 2999 + 2 and all(r["small"] == (0 if r["big"] != 9 or r["small"] == 0 else 2) for r in got)


# -- tokens ------------------------------------------------------------------------------------------------------------


def test_every_document_agrees_with_both_libraries(spark):
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, d).collect()}
    t = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    keys = sorted(texts)
    want = [e.ids for e in t.encode_batch([texts[k] or "" for k in keys], add_special_tokens=False)]
    assert got == dict(zip(keys, want, strict=True))


ODD = st.text(alphabet=st.sampled_from(list("ab1 \n\t'.,sltré日本。、🙂　​́ ")), max_size=300)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(ODD)
def test_safe_boundaries_never_matter(text):
    enc = encoder(TOKENIZER)
    whole = enc.encode_ordinary(text)
    for m in SAFE.finditer(text):
        assert enc.encode_ordinary(text[: m.start()]) + enc.encode_ordinary(text[m.start() :]) == whole


def test_corpus_ids_edges(spark):
    rng = random.Random(5)
    odd = "".join(rng.choice("ab1 \n\t'.,sltré日本。、🙂　​́") for _ in range(20_000))
    shared = "The lake was calm and 'twas late; we've seen 1234 birds. " * 40
    texts = [
        None, "", " ", "a", "<|endoftext|> x", odd, shared, shared + "tail", "head " + shared, "x" * 30_000, " " * 5000, "日本語" * 4000, "🙂" * 3000,
        "́" * 2000, "'l" * 3000, "\r\n" * 2000,
    ]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(6, shared, 0), (None, "null id", 0), (100, "one", 0), (100, "two", 0)]
    df = spark.createDataFrame(rows, "id long, t string, doc_id int")
    for bits, longest in ((9, 4096), (3, 40)):
        got = defaultdict(list)
        for r in corpus_ids(df, "id", "t", bits=bits, longest=longest).collect():
            got[r["doc_id"]].append(r["ids"])
        enc = encoder(TOKENIZER)
        for i, t in enumerate(texts):
            assert got[i] == [enc.encode_ordinary(t or "")], i
        assert got[None] == [enc.encode_ordinary("null id")] and sorted(got[100]) == sorted(map(enc.encode_ordinary, ("one", "two")))
    assert corpus_ids(df.limit(0), "id", "t").count() == 0


# -- packing -----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_pack_holds_its_limits(sizes):
    s = np.array(sizes, np.int64)
    at = pack(s, 100)
    fill = np.bincount(at, weights=s) if len(s) else np.zeros(0)
    assert len(at) == len(s) and (fill <= 100).all() and (fill > 0).all()
    assert sum(sorted(fill)[:2]) > 100 or len(fill) < 2  # no two containers could be one


def test_search_fills_hard_sizes():
    """Triplets with a perfect packing, and sizes of which no container holds more than six: by steps of every kind."""
    rng, steps = np.random.default_rng(1), {}
    x, y = rng.integers(400, 900, 1000), rng.integers(400, 900, 1000)
    triplets = np.concatenate([x, y, 2048 - x - y])
    rng.shuffle(triplets)
    assert pack(triplets, 2048, steps=steps).max() + 1 <= 1000 * 1.018
    assert all(steps.get(k, 0) > 0 for k in ("move", "one for one", "two for one", "one for two", "two for none"))
    sizes = rng.integers(300, 900, 5000)
    assert pack(sizes, 2048).max() + 1 <= 1.01 * -(-sizes.sum() // 2048)


def test_containers_hold_every_token_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(docs, "doc_id", "text").collect()}
    rows = queries.p8_containers(spark, "/root/testdata/sf0.01").collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part_no"], r["token_start"], r["n_tokens"]))
    assert max(fill.values()) <= 2048 and parts.keys() == sizes.keys()
    for k, p in parts.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == sizes[k]
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:], strict=False)) and p[0][1] == 0
        assert len(p) == max(1, -(-sizes[k] // 2048))
    assert len(fill) <= -(-sum(sizes.values()) // 2048) + 1


def test_containers_edges(spark):
    rows = [(1, b"a", 0), (2, b"b", None), (3, b"c", 2048), (4, b"d", 2049), (None, b"e", 5), (3, b"c", 2048), (5, b"f", 5000), (6, b"g", -1)]
    df = spark.createDataFrame(rows, "doc_id long, doc_key binary, n_tokens int").withColumn("shard", F.lit("x"))
    got = [tuple(r)[1:] for r in fill_containers(df, 2048, shard_items=3).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 2048), (4, 0, 0, 2048), (4, 1, 2048, 1), (None, 0, 0, 5), (5, 0, 0, 2048), (5, 1, 2048, 2048), (5, 2, 4096, 904), (6, 0, 0, 0)],
        key=repr,
    )
    assert fill_containers(df.limit(0), 2048).count() == 0


# -- splitting ---------------------------------------------------------------------------------------------------------


def test_pieces_of_every_document(spark):
    d = "/root/testdata/sf0.01"
    enc = encoder(TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in queries.p9_pieces(spark, d).collect():
        pieces[r["doc_id"]].append(r)
    long = {k for k, t in texts.items() if t and len(enc.encode_ordinary(t)) > 512}
    assert pieces.keys() == long
    cuts = []
    for k, rows in pieces.items():
        rows.sort(key=lambda r: r["piece_no"])
        ids = enc.encode_ordinary(texts[k])
        assert [r["piece_no"] for r in rows] == list(range(len(rows)))
        assert rows[0]["token_start"] == 0 and rows[-1]["token_end"] == len(ids)
        for r in rows:
            assert r["n_tokens"] == r["token_end"] - r["token_start"] <= 512
            assert r["piece"] == enc.decode(ids[r["token_start"] : r["token_end"]]) and len(enc.encode_ordinary(r["piece"])) <= 512
        for a, b in zip(rows, rows[1:], strict=False):
            assert 48 <= a["token_end"] - b["token_start"] == b["overlap_tokens"] <= 64
            if a["cut"] == "none":  # nowhere to cut: no word ends in what is new in the piece
                strength = boundary_strengths(np.array(ids), TOKENIZER)
                assert (strength[a["token_start"] + 65 : a["token_start"] + 513] <= 0).all()
            cuts.append(a["cut"])
    assert sum(c in ("paragraph", "line", "sentence") for c in cuts) > 0.8 * len(cuts)


@pytest.mark.parametrize(
    "text",
    ["a" * 20_000, "🙂" * 1500, "́" * 2000, "日本語の文章です。" * 300, "word " * 900, "\n\n".join(["One line. Two lines."] * 300), " " * 40_000, "x y" * 2000 + "​" * 900],
)
def test_pieces_of_odd_texts(text):
    enc = encoder(TOKENIZER)
    ids = np.array(enc.encode_ordinary(text))
    got = split_ids(ids, 100, 12, TOKENIZER)
    assert got[0][0] == 0 and got[-1][1] == len(ids)
    for (a, b, kind, piece), nxt in zip(got, [*got[1:], None], strict=True):
        assert 0 < b - a <= 100 and piece == enc.decode_bytes(ids[a:b].tolist())
        piece.decode()
        if nxt:
            assert a < nxt[0] <= b and b - nxt[0] <= 12
    if text.startswith("One"):
        assert {g[2] for g in got[:-1]} == {PARAGRAPH}
    if text.startswith("日"):
        assert {g[2] for g in got[:-1]} == {SENTENCE}


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(ODD, st.integers(1, 12)), min_size=1, max_size=4), st.sampled_from([(8, 3), (16, 0), (24, 11), (64, 8)]))
def test_no_piece_is_above_the_limit_by_its_own_encoding(parts, bounds):
    limit, overlap = bounds
    enc, t = encoder(TOKENIZER), "".join(p * k for p, k in parts)
    ids = np.array(enc.encode_ordinary(t), np.int64)
    if len(ids) <= limit:
        return
    got = split_ids(ids, limit, overlap, TOKENIZER, t.encode())
    assert got[0][0] == 0 and got[-1][1] == len(ids)
    for (a, b, _, piece), nxt in zip(got, [*got[1:], None], strict=True):
        assert piece == enc.decode_bytes(ids[a:b].tolist())
        assert len(enc.encode_ordinary(piece.decode())) <= limit
        if nxt:
            assert a < nxt[0] <= b < nxt[1] and b - nxt[0] <= overlap


def test_pieces_from_the_start_keep_every_limit():
    from fotomill.llm.splitting import _from_the_start, _Pieces

    enc = encoder(TOKENIZER)
    for t in ("🙂" * 300, "aé日🙂" * 200, "\u0301" * 400, "word " * 300, "x" * 3000):
        ids = np.array(enc.encode_ordinary(t), np.int64)
        got = _from_the_start(boundary_strengths(ids, TOKENIZER), 16, 7, _Pieces(ids, t.encode(), TOKENIZER))
        assert got[0][0] == 0 and got[-1][1] == len(ids)
        assert all(c <= b < d for (_, b), (c, d) in zip(got, got[1:], strict=False))
        for a, b in got:
            assert len(enc.encode_ordinary(enc.decode_bytes(ids[a:b].tolist()).decode())) <= 16


def test_split_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "word " * 600, 0), (4, "word " * 600, 0), (None, "word " * 600, 0)]
    df = spark.createDataFrame(rows, "id long, text string, doc_id int")
    got = split_texts(df, "id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["piece_no"]) for r in got) == [(0, 0), (0, 1), (4, 0), (4, 0), (4, 1), (4, 1)]
    assert split_texts(df.limit(0), "id", "text").count() == 0
