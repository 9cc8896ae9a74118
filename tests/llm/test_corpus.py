"""Operators 3, 4, 9, 10 and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from decimal import Decimal, localcontext

import numpy as np

from tellurion.llm import audio, common, decontam, neardup, sharding

from .conftest import TEXTS

_LOWER = {k: k + 32 for k in range(65, 91)}


def brute(texts, words, percent):
    """{id: (set size, component)} by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_with_dense_groups(spark):
    rng, texts = random.Random(5), {}
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(120):  # a cloud of edited copies, of which many only reach others through third ones
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = rng.choice(vocabulary)
        texts[i] = " ".join(own)
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(120, 200):  # a shared passage that is not enough
        texts[i] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))
    for i in range(200, 240):
        texts[i] = texts[i - 200].upper() if i % 2 else "a b"
    texts |= {240: None, 241: "", 242: " \t\n", 243: "x", 244: "X"}
    order = list(texts.items())
    rng.shuffle(order)
    found = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 3, 85).collect()
    want = brute(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_documents(small):
    found = neardup.near_duplicates(small, 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute({r.doc_id: r.text for r in small.collect()}, 5, 80)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    found = neardup.near_duplicates(awkward, 3, 85).collect()
    assert len(found) == len(TEXTS)
    by = {r.doc_id: r.component_id for r in found}
    assert by[4] == 1 and by[9] == 1 and by[5] == 5 and by[2] == 2 and by[3] == 3 and by[None] is None
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in found)
    assert neardup.near_duplicates(nothing).count() == 0


def test_cells_skip_nothing():
    sets = [np.array(sorted(x), np.uint64).view(np.int64) for x in ({1, 2, 3, 4, 5, 6, 7}, {1, 2, 3, 4, 5, 6, 7, 8}, {1, 2, 9}, {20})]
    signed = neardup.signatures([s.view(np.uint64) for s in sets], 64).view(np.int32)
    least = neardup.least_collisions(64, 80)
    assert sorted(neardup._meeting([(k, k, 2, sig) for k, sig in enumerate(signed)], least)) == [0, 1]
    assert neardup._cell_links([(k, k, 2, sig, s) for k, (s, sig) in enumerate(zip(sets, signed))], least, 80) == [(1, 0)]


def test_words_hashed_in_pieces(monkeypatch):
    for raw in (b"", b" ", b"a", b"ab cd  efghij k ", b"nogapsatall" * 9, b" lead and trail\n" * 7):
        data, whole = np.frombuffer(raw, np.uint8), neardup.word_hashes(np.frombuffer(raw, np.uint8))
        for size in (1, 3, 10):
            monkeypatch.setattr(neardup, "PIECE", size)
            assert all(np.array_equal(x, y) for x, y in zip(whole, neardup.word_hashes(data)))
        monkeypatch.undo()


def test_one_model_is_held():
    made = [common.held(k, lambda: object()) for k in ("a", "a", "b", "a")]
    assert made[0] is made[1] and made[3] is not made[0] and len(common._HELD) == 1


def test_least_collisions():
    assert neardup.least_collisions(64, 85) == 34 and neardup.least_collisions(64, 85, 1e-5) == 41 and neardup.least_collisions(64, 100) == 64


def test_matrix_sums_and_law():
    rows = [7, 0, 13, 5]
    m = sharding.communication_matrix(rows, 4, 1)
    assert m.sum(1).tolist() == rows and sorted(m.sum(0).tolist()) == [6, 6, 6, 7]
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(2000)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.1)
    rng = np.random.Generator(np.random.PCG64(1))
    big = np.array([sharding._hypergeometric(rng, 3 * 10**10, 2 * 10**10, 10**7) for _ in range(2000)])
    assert abs(big.mean() - 6 * 10**6) < 150 and abs(big.std() - 1549) < 100
    with localcontext() as context:
        context.prec = 50
        for k in (0, 1, 5, 170, 1000):
            assert abs(sharding._log_factorials(k) - Decimal(math.factorial(k)).ln()) < Decimal("1e-35")


def test_large_draws_follow_the_law():
    rng, choose = np.random.Generator(np.random.PCG64(3)), math.comb
    for good, bad, n in ((30, 50, 20), (5, 900, 200)):
        found = np.bincount([sharding._large(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1)
        want = np.array([choose(good, k) * choose(bad, n - k) / choose(good + bad, n) * 20_000 for k in range(n + 1)])
        often = want > 5
        assert ((found - want)[often] ** 2 / want[often]).sum() < 3 * often.sum()


def test_shards(spark, awkward, nothing):
    rows = spark.createDataFrame([(k, "same") for k in range(300)] + [(None, None)] * 50, "doc_id long, t string")
    out = sharding.shard(rows.repartition(5), 7, sub_rows=40).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == 350 and sorted(map(len, by.values())) == [50] * 7
    assert all(sorted(v) == list(range(50)) for v in by.values())
    assert sum(r.doc_id is None for r in out) == 50
    assert sharding.shard(awkward, 3).count() == len(TEXTS) and sharding.shard(nothing, 3).count() == 0
    odd = sharding.shard(spark.createDataFrame([(1, 2, 3, 4)], "Slot long, b int, k int, _row int"))
    assert odd.columns == ["b", "k", "_row", "shard", "slot"] and odd.count() == 1


def test_op4_query(spark):
    from tellurion.llm.queries import op4_sharding

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = op4_sharding(spark, folder).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    count = collections.Counter(r.shard for r in out)
    assert {r.law for r in out} == {"rows"} and max(count.values()) - min(count.values()) <= 1 and set(count) <= set(range(40))
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(40) for k in range(count[s])]


def test_streams():
    rng = random.Random(1)
    for n in (64, 128, 896, 960, 4480, 64 * 133):
        payload = rng.randbytes(n)
        raw = audio.write_stream(payload)
        got = audio.parse_stream(raw)
        assert got["payload"] == payload and got["crc_bad"] == got["junk"] == 0 and got["table"]["frames"] == got["frames"] == len(got["offsets"]) and got["samples"] == 1152 * got["frames"]
        assert all(audio.read_header(raw[o : o + 4]) for o in got["offsets"])
        spoiled = bytearray(raw)
        spoiled[got["offsets"][0] + 8] ^= 1
        assert audio.parse_stream(bytes(spoiled))["crc_bad"] == 1
        bare = b"\xff\xe2junk" + raw[raw.index(b"\xff\xfb") :] + b"TAG" + b"name".ljust(125, b"\0")
        again = audio.parse_stream(bare)
        assert again["frames"] == got["frames"] and again["junk"] == 6 and again["tags"]["v1"] == "name"
    assert audio.parse_stream(b"")["frames"] == 0 and audio.parse_stream(b"\xff" * 50)["frames"] == 0


def test_tags_and_tables_of_other_writers():
    frame = bytes([0xFF, 0xFB, 9 << 4, 0xC4]).ljust(417, b"\0")  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
    text = b"\0" + b"t" * 200
    v3 = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text + b"TPE1" + (4).to_bytes(4, "big") + b"\0\0" + b"\0abc"
    got = audio.parse_stream(b"ID3\3\0\0" + audio._syncsafe(len(v3)) + v3 + frame * 3)
    assert got["tags"] == {"TIT2": "t" * 200, "TPE1": "abc"} and got["frames"] == 3 and got["junk"] == 0
    v2 = b"TT2" + (4).to_bytes(3, "big") + b"\0xyz" + b"TP1" + (7).to_bytes(3, "big") + b"\1\xff\xfe" + "é!".encode("utf-16-le")
    assert audio.parse_stream(b"ID3\2\0\0" + audio._syncsafe(len(v2)) + v2 + frame * 2)["tags"] == {"TT2": "xyz", "TP1": "é!"}
    vbri = b"VBRI" + b"\0\1\0\0\0\0" + (1000).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + b"\0\1" + (500).to_bytes(2, "big") * 2
    head = (frame[:36] + vbri).ljust(417, b"\0")
    got = audio.parse_stream(head + frame * 3)
    assert got["table"] == {"bytes": 1000, "frames": 3, "toc": [500, 500]} and got["frames"] == 3 and got["offsets"][0] == 417
    slow = bytes([0xFF, 0xFB, 9 << 4 | 2 << 2, 0xC4]).ljust(576, b"\0")  # 32 kHz
    assert abs(audio.parse_stream(frame * 2 + slow * 2)["seconds"] - 2 * 1152 * (1 / 44100 + 1 / 32000)) < 1e-12
    layer1 = bytearray(bytes([0xFF, 0xFE, 4 << 4, 0xC4]).ljust(136, b"\0"))
    size = audio.read_header(bytes(layer1[:4]))[2]
    layer1 = layer1[:size].ljust(size, b"\0")
    layer1[4:6] = audio.frame_crc(bytes(layer1[2:4] + layer1[6:22])).to_bytes(2, "big")
    got = audio.parse_stream(bytes(layer1) * 2)
    assert (got["frames"], got["crc_checked"], got["crc_bad"]) == (2, 2, 0)


def test_media_frames(awkward, nothing):
    found = audio.read_media(audio.encode_media(awkward)).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.payload_sha256) for r in found) == want
    assert len({r.feature for r in found if r.doc_id in (1, 4)}) == 1
    assert audio.read_media(audio.encode_media(nothing)).count() == 0


def test_wand_finds_all():
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(5, 20))), "") for k in range(150)]
    index = decontam.Index(items)
    for _ in range(150):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, len(index.terms))))
        score = collections.defaultdict(float)
        for t in terms:
            for k, x in zip(*index.post[t]):
                score[k] += x
        for theta in (0.1, 0.3, 0.6):
            assert sorted(k for k, _ in index.wand(terms, theta)) == sorted(k for k, s in score.items() if s >= theta - 1e-12)


def test_leaks(spark, nothing):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {(r.doc_id, h.item_id) for r in decontam.decontaminate(docs, items).collect() for h in r.hits}
    texts, own = docs.collect(), items.collect()
    fold = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    want = {(d.doc_id, i.item_id) for d in texts for i in own if f" {fold(i.text)} " in f" {fold(d.text)} "}
    assert found == want and want
    parts = {(r.doc_id, h.item_id) for r in decontam.decontaminate(docs, items, items_per_pass=15).collect() for h in r.hits}
    assert parts == want
    assert decontam.decontaminate(nothing, items).count() == 0 and decontam.decontaminate(docs, items.where("false")).where("contaminated").count() == 0


def test_edited_items_near_the_threshold(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.choice((15, 25, 38, 59)))] for k in range(80)}
    docs = {}
    for i in range(300):
        own = list(items[i % 80])
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            own = own[: len(own) // 2]
        docs[i] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))] + own + [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(i, k) for i, d in docs.items() for k, q in items.items() if len(runs(q) & runs(d)) >= 0.8 * len(runs(q))}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, h.item_id): h for r in decontam.decontaminate(d, b).collect() for h in r.hits}
    assert set(found) == want and any(h.overlap < 1 for h in found.values()) and len(want) < 300
    parts = {(r.doc_id, h.item_id): h for r in decontam.decontaminate(d, b, items_per_pass=12).collect() for h in r.hits}
    assert set(parts) == want and all(abs(parts[k].score - found[k].score) < 1e-9 and parts[k].start == found[k].start for k in want)
    assert decontam.keep_clean(d, b, items_per_pass=12).count() == 300 - len({i for i, _ in want})


def test_question_and_answer_must_both_be_held(spark):
    q, a = "what is the longest river of the northern hills and its name", "it is the quiet brook that runs past the old mill"
    b = spark.createDataFrame([(1, q, a)], "item_id long, q string, a string")
    d = spark.createDataFrame([(1, f"{q} {a}"), (2, q), (3, f"{q} and {a}")], "doc_id long, text string")
    assert {r.doc_id for r in decontam.decontaminate(d, b, theta=0.4, question_col="q", answer_col="a").collect() if r.contaminated} == {1, 3}


def test_leaks_in_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    hit = {r.doc_id for r in decontam.decontaminate(awkward, items).collect() if r.contaminated}
    assert hit == {1, 4, 9}
    assert decontam.keep_clean(awkward, items).count() == len(TEXTS) - 3


def test_ids_with_several_texts(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(3))
    rows = [(5, a), (5, b), (7, b + " end"), (3, b), (5, b), (9, c), (9, c), (None, a), (None, b)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert collections.Counter((r.doc_id, r.component_id, r.kept) for r in found) == {(5, 5, True): 1, (5, 3, False): 2, (7, 3, False): 1, (3, 3, True): 1, (9, 9, True): 2, (None, 5, False): 1, (None, 3, False): 1}


def test_guests_and_hosts_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(2000)]
    base, texts = [rng.choice(vocabulary) for _ in range(60)], {}
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        texts[i] = " ".join(own)
    found = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(texts, 3, 85)


def awkward_documents(spark):
    rows = [(i, t, "en", "web", len(t or ""), 1, "x", 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, text_hash string, own_id int, kept int")


def test_stages_on_awkward_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = awkward_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false"), docs.where("text is null"), docs.where("doc_id is null")):
            out = stage(spark, table, folder)
            assert out.count() <= table.count() and (name == "encode" or out.columns == docs.columns), name
    dedup = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = collections.Counter((r.doc_id, (r.text or "")[:3]) for r in dedup(spark, docs, folder).collect())
    assert left == {(1, "The"): 1, (2, ""): 1, (3, ""): 1, (None, "los"): 1, (5, "x"): 1, (6, "1 2"): 1, (7, "Ünï"): 1, (8, "lon"): 1}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs, name)
        assert 0 < docs.count() <= before
        before = docs.count()
        if name == "near_dedup":
            parts = brute({r.doc_id: r.text for r in docs.collect()}, 5, 80)
            assert all(i == root for i, (_, root) in parts.items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
