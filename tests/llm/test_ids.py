"""Sharding, token counts, JPEG columns, packing: exact laws and round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import SF, TEXTS, edge_docs, empty_docs, prose, repeated, table
from tidemark import llm
from tidemark.llm import jpeg, packing, sharding, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def utf8(t):
    return (t or "").encode()


def test_shards_follow_the_law(spark):
    got, docs = llm.queries()["op1_kd_sharding"](spark, SF).toPandas(), table("documents")
    own = dict(zip(docs.doc_id, docs.text))
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(r.size_ == len(utf8(own[r.doc_id])) + 16 and r.text_crc32 == zlib.crc32(utf8(own[r.doc_id])) for r in got.rename(columns={"size": "size_"}).itertuples())
    assert got.shard.between(0, 39).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_shards_are_near_equal_and_hot_copies_are_cut(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else prose(i, 12), "en", "hot") for i in range(6000)], "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(docs, 8).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 8 and got.max() < 1.12 * got.mean() and got.min() > 0.88 * got.mean()


def brute_leaves(items, leaves, first, spans, out):
    """The tree over all items at hand: (weight, coordinates, low hash) by exact weighted medians."""
    if leaves == 1 or not items:
        out.update({i: first for i, *_ in items})
        return
    dims = range(len(spans))
    dim = max(dims, key=lambda d: ((max(x[2][d] for x in items) - min(x[2][d] for x in items)) / spans[d], -d))
    keys = Counter()
    for _, w, at, low in items:
        keys[(at[dim] << sharding.HASH) | low] += w
    want, below, cut = sum(keys.values()) * (leaves // 2) / leaves, 0, None
    for key in sorted(keys):
        if below + keys[key] >= want:
            cut = key if want - below > below + keys[key] - want else key - 1
            break
        below += keys[key]
    left = [x for x in items if (x[2][dim] << sharding.HASH) | x[3] <= cut]
    brute_leaves(left, leaves // 2, first, spans, out)
    kept = {x[0] for x in left}
    brute_leaves([x for x in items if x[0] not in kept], leaves - leaves // 2, first + leaves // 2, spans, out)


@pytest.mark.parametrize("leaves", [2, 7, 16])
def test_the_tree_is_that_of_exact_medians(spark, leaves):
    import random

    r = random.Random(leaves)
    items = [(i, r.randrange(1, 100), (r.randrange(1 << 20), r.choice([5, 6, 1 << 23]), r.randrange(50)), r.randrange(1 << 38)) for i in range(700)]
    want: dict = {}
    spans = [max(1, max(x[2][d] for x in items) - min(x[2][d] for x in items)) for d in range(3)]
    brute_leaves(items, leaves, 0, spans, want)
    made = spark.createDataFrame([(i, w, low, *at) for i, w, at, low in items], "id long, weight long, low long, d0 long, d1 long, d2 long")
    got = {x.id: x.node for x in sharding.kd_leaves(made, leaves, 3, tolerance=0.0).collect()}
    assert got == want and len(set(got.values())) == leaves


def test_copies_share_a_shard_where_they_are_light(spark):
    docs = spark.createDataFrame([(i, prose(i % 500, 20), "en", f"s{i % 5}") for i in range(1000)], "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(docs, 4).toPandas()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()


def test_shards_of_edge_cases(spark):
    got = sharding.kd_shards(repeated(spark), 3).toPandas()
    assert len(got) == len(TEXTS) + 5 and got.row_id.isna().sum() == 3
    assert sharding.kd_shards(empty_docs(spark), 3).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(64, 2), (1000, 16), (1 << 15, 256)])
def test_chunks_count_as_the_whole_text(chunk, overlap):
    for t in [*filter(None, TEXTS), prose(5, 4000) + "\n\n\n" + "y" * 300 + prose(6, 200)]:
        assert tokens.count_by_chunks(LIB, t, chunk, overlap)[0] == len(ids_of(t)), t[:40]


def test_splices_are_found_without_widening_in_prose():
    assert tokens.count_by_chunks(LIB, prose(7, 4000), 1000, 64) == (len(ids_of(prose(7, 4000))), 0)


def test_token_counts(spark):
    docs = table("documents")
    got = llm.queries()["op2_token_counts"](spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        n = len(ids_of(t))
        assert tuple(got.loc[d]) == (len(utf8(t)), n, n > 512)
    edge = tokens.token_counts(edge_docs(spark), PATH, chunk=500, overlap=8).toPandas()
    assert list(edge.n_tokens) == [len(ids_of(t)) for t in TEXTS]
    assert tokens.token_counts(empty_docs(spark), PATH).count() == 0


def test_encoder_gives_the_ids_of_the_library():
    enc = tokens.encoder(PATH)
    assert enc.ranked is not None
    odd = ["x" * 300_000, " " * 300_000 + "end", "a" + " \n" * 100_000, "'s'S 't'Re 'll" * 20, "\u0000\ud7ff\ufffd\U0010ffff", "<|endoftext|><|endoftext|> <|endoftext|"]
    for t in [*TEXTS, *odd, *table("documents", "/root/testdata/sf0.01").text]:
        assert enc.encode(t or "").tolist() == ids_of(t)


def test_encoder_cuts_at_every_character_as_the_library_does():
    enc = tokens.encoder(PATH)
    for at in range(0, 0x110000, 64):
        own = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}a1{c}1 {c}!{c}!" for c in own)
        assert enc.encode(text).tolist() == ids_of(text), hex(at)


def test_every_token_of_the_vocabulary_is_one_token():
    """Merges by rank and merges by pair agree: each token's bytes alone become that token in both."""
    enc = tokens.encoder(PATH)
    for t in LIB.get_vocab():
        text = LIB.decode([LIB.token_to_id(t)])
        assert enc.encode(text).tolist() == ids_of(text), t


def test_other_vocabularies_go_through_the_library():
    enc = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.ranked is None
    lib = Tokenizer.from_file(enc.path)
    for t in filter(None, TEXTS[:13]):
        assert enc.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_media_round_trip(spark):
    docs = table("documents")
    got = llm.queries()["op3_jpeg_media"](spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        raw = utf8(t)
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got.loc[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.feature.count(":") == 3 and r.error is None


def test_media_of_edge_cases(spark):
    stored = jpeg.store_payloads(edge_docs(spark))
    got = jpeg.read_media(stored.withColumnRenamed("media", "m"), "m").toPandas()
    for t, f in zip(TEXTS, got.features):
        assert f["payload_sha256"] == hashlib.sha256(jpeg.payload_of(t)).hexdigest()
    assert jpeg.read_media(jpeg.store_payloads(empty_docs(spark))).count() == 0


def test_damaged_media_say_so():
    good = jpeg.encode_payloads([jpeg.payload_of(prose(3, 50))])[0]
    found = jpeg.read_batch([None, b"", b"GIF89a", good[: len(good) // 2], good])
    assert [r["payload"] is not None for r in found] == [False] * 4 + [True] and all(r["error"] for r in found[:4])


def test_packing(spark):
    docs = table("documents")
    check_pieces(llm.queries()["op5_cost_balanced_packing"](spark, SF).toPandas().rename(columns={"doc_id": "row_id"}), dict(zip(docs.doc_id, docs.text)), 2048)


def check_pieces(got, texts, capacity, padding=0.02):
    for d, g in got.groupby("row_id"):
        ids, at = np.array([*ids_of(texts[d]), 1], "<u4"), 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert set(got.row_id) == set(texts)
    for _, g in got.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= capacity
    n = got.sequence_id.nunique()
    assert n * capacity - got.length.sum() <= max(capacity, padding * n * capacity)


def test_packing_of_edge_cases(spark):
    docs = edge_docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(packing.pack(docs, PATH, capacity=64).toPandas(), texts, 64, 0.05)
    assert packing.pack(empty_docs(spark), PATH).count() == 0
    got = packing.pack(repeated(spark), PATH).toPandas()
    assert Counter(got[got.start == 0].row_id.isna())[True] == 3


def test_descending_documents_go_to_the_cheapest_sequence_with_room():
    lengths = np.array([7, 6, 3, 2, 2])
    got = packing.assign(lengths, 10)
    assert sum(n for _, _, n, _, _ in got) == 20 and {s for *_, s, _ in got} == {0, 1}
    assert [(i, s) for i, _, _, s, _ in got[:3]] == [(0, 0), (1, 1), (2, 1)]
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


# Code lengths of the DC tables of Annex K; the AC table is a small one of the test's own.
DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_OWN = (bytes([0, 2, 1, 1] + [0] * 12), bytes([0x00, 0x01, 0x12, 0xF0]))


def foreign_image(width, height, dc, sampling, restart=0, quant=16):
    """A baseline JPEG of several components, written bit by bit: dc[component] lists the DC of its blocks in coding order."""
    codes = {}
    for name, (counts, symbols) in {"luma": DC_LUMA, "chroma": DC_CHROMA, "ac": AC_OWN}.items():
        code, at = 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                codes[name, symbols[at]] = f"{code:0{n}b}"
                code, at = code + 1, at + 1
            code <<= 1
    amplitude = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    pack = lambda b: bytes(int(b[i : i + 8].ljust(8, "1"), 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus = -(-width // (8 * most_h)) * -(-height // (8 * most_v))
    data, bits, before, at = b"", "", [0] * len(dc), [0] * len(dc)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            data, bits, before = data + pack(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), "", [0] * len(dc)
        for c, (h, v) in enumerate(sampling):
            for _ in range(h * v):
                value = dc[c][at[c]]
                diff, before[c], at[c] = value - before[c], value, at[c] + 1
                bits += codes["chroma" if c else "luma", abs(diff).bit_length()] + amplitude(diff)
                # Some blocks have coefficients, behind runs of one and of sixteen zeros.
                bits += (codes["ac", 0x01] + "1" + codes["ac", 0x12] + "10" + codes["ac", 0xF0] + codes["ac", 0x01] + "0" if at[c] % 3 == 0 else "") + codes["ac", 0x00]
    part = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(dc)]) + b"".join(bytes([c + 1, h << 4 | v, c > 0]) for c, (h, v) in enumerate(sampling))
    order = bytes([len(dc)]) + b"".join(bytes([c + 1, (c > 0) << 4]) for c in range(len(dc))) + bytes([0, 63, 0])
    tables = part(0xDB, bytes([0]) + bytes([quant] * 64) + bytes([1]) + bytes([99] * 64)) + part(0xC4, bytes([0]) + b"".join(DC_LUMA) + bytes([1]) + b"".join(DC_CHROMA) + bytes([16]) + b"".join(AC_OWN))
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + tables + part(0xC0, frame) + (part(0xDD, restart.to_bytes(2, "big")) if restart else b"") + part(0xDA, order) + data + pack(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2])
@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)]])
def test_images_of_other_writers(sampling, restart):
    import random

    r = random.Random(len(sampling) + restart)
    width, height = 40, 24
    h, v = sampling[0]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    dc = [[r.randrange(-60, 61) for _ in range(across * down * a * b)] for a, b in sampling]
    found = jpeg.read_batch([foreign_image(width, height, dc, sampling, restart), None])[0]
    want = np.zeros((down * v, across * h), np.int64)
    for i, value in enumerate(dc[0]):
        m, block = divmod(i, h * v)
        want[m // across * v + block // h, m % across * h + block % h] = np.clip((value * 16 + 4) // 8 + 128, 0, 255)
    assert (found["width"], found["height"], found["error"], found["payload"]) == (width, height, None, None)
    assert found["thumb"].tolist() == want.tolist()
