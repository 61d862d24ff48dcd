import gzip
import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from evidenta.llm import bpe, decontaminate, html_extract, language, lm_score, oracles, quality, queries, sharding, simhash, token_counts, warc

DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "", None, "a", "Été 北京 🙂 I'm 12.5  x\n\ty", "<|endoftext|> end", "word " * 3000 + "Z"]


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, x, "en", "s", 0 if x is None else len(x)) for k, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    result = c.execute(oracles.ORACLES[name])
    names = [x[0] for x in result.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted([plain(x) for x in r] for r in df.select(*names).collect()) == sorted([plain(x) for x in r] for r in result.fetchall())


def test_token_counts_and_bpe_equal_the_library(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    tok.no_truncation()
    tok.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    counted = {r["doc_id"]: r for r in token_counts.token_counts(docs, VOCABULARY, chunk_chars=2048, overlap=256).collect()}
    coded = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, VOCABULARY).collect()}
    for k, x in enumerate(TEXTS):
        ids = tok.encode(x or "", add_special_tokens=False).ids
        assert (counted[k]["n_tokens"], counted[k]["n_bytes"]) == (len(ids), len((x or "").encode()))
        assert coded[k]["n_tokens"] == len(ids)
        assert coded[k]["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert coded[k]["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    at = f"/root/testdata/sf{sf}"
    tok = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 1 << 14  # some are spliced
    ids = dict(zip(texts, (e.ids for e in tok.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {tuple(r) for r in queries.op3_token_counts(spark, at).collect()} == {(k, len(texts[k].encode()), len(x), len(x) > 512) for k, x in ids.items()}
    assert {tuple(r) for r in queries.op10_bpe_round_trip(spark, at).collect()} == {(k, len(x), sha(",".join(map(str, x)).encode()), sha(tok.decode(x, skip_special_tokens=False).encode())) for k, x in ids.items()}


def test_very_long_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    words = "".join(rng.choice(["the ", "Straße ", "x1 ", "  ", "\n", "I'm ", "北京", "🙂 ", "<|endoftext|>", "0.25,"]) for _ in range(150000))
    texts = [words, "ab" * 100000, " " * 70000 + "x", "a" * 40000 + " " + "b" * 40000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [r["n_tokens"] for r in token_counts.token_counts(docs, VOCABULARY).orderBy("doc_id").collect()] == want
    first = docs.limit(1)
    ids = tok.encode(words, add_special_tokens=False).ids
    r = bpe.bpe_round_trip(first, VOCABULARY).first()
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_a_run_without_boundaries_is_encoded_in_linear_time():
    counter = token_counts.load(VOCABULARY, 1 << 10, 1 << 8)
    asked, encoded = [], counter.encoded
    counter.encoded = lambda text, a, b: asked.append(b - a) or encoded(text, a, b)
    try:
        n = sum(map(len, counter.spliced("a" * 100000)))
    finally:
        del counter.encoded
    assert n == len(encoded("a" * 100000, 0, 100000)[0]) and sum(asked) < 4 * 100000


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_by_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    root = components_of(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, DIR).collect()}
    assert got == {k: (f"{p:016x}", root[k]) for k, p in prints.items()}


def test_simhash_large_group_links_like_pairs(spark):
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    df = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, node long")
    from evidenta.llm.components import components

    found = components(simhash.links(df)).collect()
    assert {r["component"] for r in found} == {0} and len(found) == len(prints) - 1  # the smallest node has no row


@pytest.mark.parametrize("hubs", [1 << 12, 1, 10**9])
def test_components_of_hubs_paths_and_loops(spark, monkeypatch, hubs):
    from evidenta.llm import components as C

    monkeypatch.setattr(C, "HUBS", hubs)
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5000, 5000), (2001, 2000), (2000, 2001), (2002, 2000)]
    found = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 400)}, **{k: 1000 for k in range(1001, 1051)}, 2001: 2000, 2002: 2000}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_blocks_pairs_and_clashing_names(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = [*base, *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:60]), *(b ^ 0b111 for b in base[60:80])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    from evidenta.llm.components import components

    found = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(signed(p), k) for k, p in enumerate(prints)], "fp long, node long"))).collect()}
    want = components_of(dict(enumerate(prints)))
    assert found == {k: c for k, c in want.items() if c != k}
    rows = spark.createDataFrame([("b", "x y z", 1), ("a", "x y z", 2), (None, None, 3), ("c", "", 4)], "doc_id string, text string, component_id int")
    got = simhash.near_duplicates(rows.withColumn("simhash", F.lit("mine")))
    assert sorted(got.columns) == ["component_id", "doc_id", "simhash"]
    assert sorted((r["doc_id"] or "", r["component_id"]) for r in got.collect()) == [("", "c"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_simhash_rows_without_a_key_link(spark, monkeypatch):
    prints = {"a": 0b1, "b": 0b111, "c": 0b11111, "far": -1, "near": -4}  # a and c are linked by b alone
    monkeypatch.setattr(simhash, "fingerprints", lambda df, text, name: df.withColumn(name, F.element_at(F.create_map(*(F.lit(x) for p in prints.items() for x in p)), F.col(text)).cast("long")))
    rows = spark.createDataFrame([(7, "a"), (None, "b"), (9, "c"), (None, "far"), (None, "near")], "doc_id long, text string").withColumn("t", F.col("text"))
    got = {r["t"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    assert got == {"a": 7, "b": 7, "c": 7, "far": None, "near": None}
    import corpus_pipeline

    kept = [r["text"] for r in corpus_pipeline.dedup_stage(spark, rows.drop("t"), DIR).collect()]
    assert len(kept) == 2 and "a" in kept and {*kept} & {"far", "near"}


def test_language_held_out_accuracy(spark):
    df = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = df.where("held_out and lang is not null").collect()
    sure = [r for r in rows if len((r["text"] or "").split()) >= 20]
    assert sum(r["lang"] == r["lang_pred"] for r in sure) / len(sure) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_letters_clashes_and_many_labels(spark, monkeypatch):
    rows = [(k, ("der die das und nicht " if k % 2 else "the and of with that ") * 9, "de" if k % 2 else "en", "mine", 7.0) for k in range(40)]
    rows += [(None, "no key here", "en", "mine", 7.0), (41, None, "en", "mine", 7.0), (42, "² ½ ③ 12", "en", "mine", 7.0), (42, "² ½ ③ 12", "en", "mine", 7.0), (43, "der die das und nicht " * 300000, None, "mine", 7.0), (44, "", "de", "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.train(df)
    got = language.identify(df, model).collect()
    assert df.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[k][0] == ("de" if k % 2 else "en") for k in range(40)) and by[43][0] == "de"
    assert by[41] == by[42] == by[44] == ("und", 0.0)
    monkeypatch.setattr(language, "MODEL_BYTES", 4 << 14)
    small = language.train(df)
    assert small.dims == 1 << 14 and small.predict(rows[0][1])[0] == "en" and small.predict(rows[1][1])[0] == "de"
    monkeypatch.setattr(language, "MODEL_BYTES", 4 << 9)
    with pytest.raises(ValueError, match="too many languages"):
        language.train(df)


def test_language_without_letters_or_labels(docs):
    model = language.train(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()} == {("und", 0.0)}


def test_arc_versions_and_declared_lengths():
    payload = b"http://looks.like/a-header 0.0.0.0 20200101000000 text/html 3\nabc\n"
    for version in (1, 2):
        data = b"\n".join([warc.version_block(version, "x"), warc.arc_record(version, "http://a b/é", warc.http_block(7, payload)), warc.arc_record(version, None, b"")]) + b"\n"
        records = list(warc.parse_arc(data))
        assert [r.url for r in records] == ["filedesc://x", "http://a%20b/%C3%A9", "-"]
        assert warc.http_parts(records[1].block) == ({b"content-type": b"text/html; charset=utf-8", b"x-archive-key": b"7", b"content-length": str(len(payload)).encode()}, payload)
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-20] + b"x", strict=True))


def test_arc_damage_is_kept():
    first = warc.version_block(1, "x") + b"\n"
    good = b"http://a/1 0.0.0.0 20200101 text/html; charset=utf-8 5\nhello\n"
    blank = b"http://a/with blank 0.0.0.0 2020 text/plain 2\nok\n"
    short = b"http://a/3 0.0.0.0 20200101000000 text/html 50\nshort"
    found = list(warc.parse_arc(first + good + b"rubbish\nmore rubbish\n" + blank + short))[1:]
    assert [(r.url, r.mime, r.status, r.block) for r in found] == [
        ("http://a/1", "text/html; charset=utf-8", "-", b"hello"),
        ("-", "application/octet-stream", "damaged", b"rubbish\nmore rubbish\n"),
        ("http://a/with blank", "text/plain", "-", b"ok"),
        ("-", "application/octet-stream", "damaged", short),
    ]
    assert [r.status for r in warc.parse_arc(b"no archive at all")] == ["damaged"] and list(warc.parse_arc(b"")) == []


@pytest.mark.parametrize("limit", [warc.BROADCAST_BYTES, -1])
def test_warc_bytes_long_payloads_and_clashing_names(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
    bodies = {1: b"\xff\xfe\x00raw \x80 bytes\r\n\r\n", 2: b"long " * 3_000_000, 3: b"\xff\xfe\x00raw \x80 bytes\r\n\r\n", 4: "é".encode(), 5: b"", 6: None}
    pages = spark.createDataFrame([(k, "u", bytearray(b) if b is not None else None, "mine", 1) for k, b in bodies.items()], "page_id long, url string, html binary, file string, payload int")
    got = {int(r["key"]): (r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.archive_round_trip(pages, f"file://{tmp_path}/a").collect()}
    want = {k: ("response", None, len(b or b""), b or b"") for k, b in bodies.items()}
    want |= {1: ("revisit", "3", len(bodies[1]), None), 5: ("revisit", "6", 0, None)}
    assert got == want


def test_arc_files_of_others_are_read(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    good = b"http://a/1 0.0.0.0 20200101 text/html; charset=utf-8 5\nhello\n"
    (tmp_path / "arc/own.txt.gz").write_bytes(gzip.compress(warc.version_block(1, "x") + b"\n" + good + b"rubbish"))
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = sorted((r["record_type"], r["target_uri"], bytes(r["payload"])) for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect())
    assert got == [("resource", "-", b"rubbish"), ("resource", "http://a/1", b"hello")]


def test_warc_nulls_and_copies(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "same\r\n\r\nWARC/1.1"), (4, "u", "same\r\n\r\nWARC/1.1"), (4, "u", "same\r\n\r\nWARC/1.1")], "page_id long, url string, html string")
    got = sorted((int(r["key"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(pages, f"file://{tmp_path}/a", version=2).collect())
    assert got == sorted([(1, "revisit", "2", 0), (2, "response", None, 0), (3, "revisit", "4", 16), (4, "response", None, 16), (4, "revisit", "4", 16)])
    first = next((tmp_path / "a/warc").rglob("*.gz"))
    assert gzip.decompress(first.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(pages.where("false"), f"file://{tmp_path}/b").collect() == []


def test_shard_tiers():
    shards = [sharding.Shard(str(k), 100, k) for k in range(9)] + [sharding.Shard("big", 900, 9)]
    assert [len(g) for g in sharding.merge_groups(shards, target=500, fan_in=4, least=100)] == [5, 4]
    assert sharding.merge_groups(shards[:3], target=500, fan_in=4, least=100) == []


def test_shards_reach_and_keep_the_target(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, "".join(chr(rng.randrange(32, 1000)) for _ in range(200)), "x") for k in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, __group string").withColumn("__file", F.lit(None).cast("string")).repartition(2).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    target = 256 << 10
    n = sharding.rows_of(docs, target)
    assert 0 < n < 6000 // 4
    store = sharding.shard([docs.where(F.col("doc_id") % 5 == k) for k in range(5)] + [docs.where("false")], f"file://{tmp_path}/s", target, rows=n)
    sizes = [s.size for s in store.manifest()[1]]
    assert max(sizes) <= 1.2 * target and sum(x > target / 2 for x in sizes) >= len(sizes) - 2
    assert store.read(docs.schema).exceptAll(docs).count() == 0 and store.read(docs.schema).count() == 6000
    with pytest.raises(ValueError, match="arrived"):
        sharding.shard([], f"file://{tmp_path}/none")


def test_shard_store(spark, docs, tmp_path):
    store = sharding.shard([docs.repartition(3), docs.repartition(3)], f"file://{tmp_path}/s")
    assert store.versions()[:2] == [1, 2] and len(store.versions()) > 2
    assert store.read(docs.schema).exceptAll(docs.unionByName(docs)).count() == 0 and store.read(docs.schema).count() == 16
    assert store.read(docs.schema, 1).count() == 8
    with pytest.raises(sharding.Conflict):
        store.commit(2, [])
    assert store.vacuum() > 0 and store.read(docs.schema).count() == 16
    assert all(json.loads(p.read_text()) is not None for p in (tmp_path / "s/manifest").glob("v*.json"))


def test_lm_scores_by_brute_force(docs):
    split = {k: (x or "").lower().split() for k, x in enumerate(TEXTS)}
    one, two = Counter(w for ws in split.values() for w in ws), Counter(p for ws in split.values() for p in zip(ws, ws[1:]))
    total = one.total()
    want = defaultdict(float)
    for k, ws in split.items():
        for i, w in enumerate(ws):
            n = two[ws[i - 1], w] if i else 0
            want[k] += math.log(n / one[ws[i - 1]]) if n >= 2 else (math.log(0.4) if i else 0) + math.log(one[w] / total)
    for r in lm_score.lm_scores(docs).collect():
        assert r["n_words"] == len(split[r["doc_id"]])
        assert r["log_score"] == pytest.approx(want[r["doc_id"]], abs=1e-2)


@pytest.mark.parametrize(("heavy", "order"), [(lm_score.HEAVY, 3), (4, 3), (4, 2), (0, 2), (0, 1)])
def test_lm_scores_of_any_order_by_brute_force(spark, monkeypatch, heavy, order):
    # fewer or no frequent n-grams: counts come from the join; a full bitmap: every word and n-gram is asked for
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    if not heavy:
        made = lm_score.Known.__init__

        def full(self, *a, **b):
            made(self, *a, **b)
            self.bits[:] = 255

        monkeypatch.setattr(lm_score.Known, "__init__", full)
    rng = random.Random(order)
    split = [x.split() for x in ("a b c a b c", "a b c d", "x y z", "b c a b d", "", "a", "q a b c x y")]
    split += [[rng.choice("abcdefghijklmnopq") for _ in range(rng.randrange(40))] for _ in range(20)]
    of = [Counter(tuple(ws[i : i + n]) for ws in split for i in range(len(ws) - n + 1)) for n in (1, 2, 3)]

    def score(gram):
        n = len(gram)
        if n == 1:
            return math.log(of[0][gram] / of[0].total()), 0
        if of[n - 1][gram] >= 2:
            return math.log(of[n - 1][gram] / of[n - 2][gram[:-1]]), 0
        below, steps = score(gram[1:])
        return below + math.log(0.4), steps + 1

    want = [[score(tuple(ws[max(i - order + 1, 0) : i + 1])) for i in range(len(ws))] for ws in split]
    assert max(steps for w in want for _, steps in w) == order - 1
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(split)], "doc_id long, text string")
    for r, w in zip(lm_score.lm_scores(docs, order=order).orderBy("doc_id").collect(), want, strict=True):
        assert r["n_backoffs"] == sum(steps for _, steps in w)
        assert r["log_score"] == pytest.approx(sum(x for x, _ in w), abs=1e-3)


def test_grams_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c", "", " d  e\tf g ", "a", "b c d e f g"])
    known = lm_score.Known(spark.createDataFrame([], "key long, n long, micro long"), 1)
    known.bits[:] = 255  # any word may be repeated

    def found():
        out = []
        for part, owner, _, _, block in lm_score.blocks(texts, known, 3):
            assert len(owner) == part.stop - part.start == len(block.position)
            out += [(part.start + i, n, key, context, shorter) for n in (2, 3) for i, key, context, shorter in zip(*(x.tolist() for x in block.level(n)), strict=True)]
        return sorted(out)

    whole = found()
    assert len(whole) == 2 + 3 + 5 + 1 + 2 + 4 and len({x[2] for x in whole}) == len(whole) - 6  # b c, d e, e f, f g, d e f, e f g are there twice
    monkeypatch.setattr(lm_score, "STEP", 3)
    assert found() == whole


def test_grams_are_counted_in_rows_of_many_keys(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    blocks = [np.concatenate([rng.integers(0, 1 << 62, 5000), rng.integers(0, 300, 5000), np.full(3000, -7)]) for _ in range(4)]
    blocks[3][:4000] = blocks[0][:4000]  # repeated in another block only
    for others in (0, 2):
        rows = pa.Table.from_batches([lm_score.packed(2, x, [x + 1, x + 2][:others], 9) for x in blocks])
        assert rows.num_rows == 9 * 4
        parts = [x for k in range(9) for x in lm_score.counted(iter(rows.filter(pa.compute.equal(rows["bucket"], k)).to_batches()), 2)]
        got = [tuple(r.values()) for x in parts for r in x.to_pylist()]
        key, n = np.unique(np.concatenate(blocks), return_counts=True)
        assert sorted(got) == [(2, k, c, k + 1 if others else None, k + 2 if others else None) for k, c in zip(key.tolist(), n.tolist()) if c > 1]
    monkeypatch.setattr(lm_score, "BUCKET", 10)
    docs = spark.createDataFrame([(x,) for x in ["a b c a b", "b c a", "x y", "", "c a b x y z"] * 3], "text string")
    known = lm_score.Known(spark.createDataFrame([], "key long, n long, micro long"), 1)
    known.bits[:] = 255
    found = lm_score.gram_counts(docs, known, 3, 4, 48)
    want = Counter(tuple(x.split()[i : i + n]) for x in ["a b c a b", "b c a", "x y", "", "c a b x y z"] * 3 for n in (2, 3) for i in range(len(x.split()) - n + 1))
    assert sorted((r["level"], r["n"]) for r in found.collect()) == sorted((len(g), n) for g, n in want.items() if n >= 4)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # no row for a single n-gram meets one


def test_word_hashes():
    import pyarrow as pa

    words = ["a" * n + c for n in range(140) for c in ("", "b", "\0", "\0b", "Z" * 8)] + [str(k) for k in range(20000)] + ["été", "北京", "🙂"]
    words = sorted(set(words))
    got = lm_score.digests(pa.array(words))
    assert len(set(got.tolist())) == len(words)
    assert lm_score.digests(pa.array(words, pa.large_string()).slice(77, 900)).tolist() == got[77:977].tolist()
    assert lm_score.digests(pa.array([], pa.string())).tolist() == []


def test_html_extraction(spark):
    article = "<article><h1>Title</h1><p>First &amp; long   paragraph of the page, number {}.</p><p>Second text {} here.</p></article>"
    page = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav>" + article + "<div class='comments'><p>reader says</p></div><footer>(c)</footer><script>x()</script></body></html>"
    rows = [(k, "http://h.example/" + str(k), page.format(k, k)) for k in range(6)] + [(9, None, None), (10, "http://h.example/", "")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].endswith("First & long paragraph of the page, number 3.\n\nSecond text 3 here.")
    assert got[9] == got[10] == "" and not any(w in got[3] for w in ("Home", "reader", "(c)", "x()"))


def extracted(spark, pages):
    df = spark.createDataFrame([(k, "http://h.example/" + str(k), x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract_text(df).orderBy("page_id").collect()]


def test_html_boxes_of_few_pages_stay(spark):
    box = "<ul class='specs'><li>shared item</li></ul>"
    for a, b in (("<article>", "</article>"), ("", "")):
        got = extracted(spark, [f"<html><body>{a}<h1>T {k}</h1><p>Text of page {k}.</p>{box if k < 5 else ''}{b}</body></html>" for k in range(20)])
        assert ["shared item" in x for x in got] == [k < 5 for k in range(20)]
    copies = ["<html><body><h1>Same</h1><dl><dt>copied term</dt></dl></body></html>"] * 6
    got = extracted(spark, copies + [f"<html><body><h1>T {k}</h1><p>Text {k}.</p></body></html>" for k in range(5)])
    assert all("copied term" in x for x in got[:6])


def test_html_constant_box_on_long_pages(spark):
    def page(k):
        parts = [f"<h2>Head {k} {i}</h2><p>Text {k} {i}.</p>" for i in range(30 + k)]
        parts.insert(7 + k, "<div><b>unnamed</b> notice</div>")
        parts.insert(3, f"<div>Remark {k}</div>")
        return "<html><body>" + "".join(parts) + "</body></html>"

    got = extracted(spark, [page(k) for k in range(8)])
    assert not any("notice" in x for x in got)
    assert [x.count("\n\n") for x in got] == [2 * (30 + k) for k in range(8)]


def test_html_deep_elements_close_themselves():
    n = 130
    deep = "<div>" * n + "in<nav>menu <div>more menu</div></nav>side" + "</div>" * n
    page = f"<html><body><article><p>start</p>{deep}<p>end</p></article><div>outside</div></body></html>"
    assert html_extract.extract(page, None) == "start\n\nin\n\nside\n\nend"
    boxed = f"<html><body><div class='ad'>{'<div>' * n}x{'</div>' * (n - 1)}<p>still the box</p></div></div><p>main text</p></body></html>"
    assert html_extract.extract(boxed, None) == "main text"


def test_html_inline_hidden_elements_close():
    page = '<html><body><article><p>one <span hidden>no</span> two</p><p>three</p><i aria-hidden="true"></i> tail text<p>x</p></article></body></html>'
    assert html_extract.extract(page, None) == "one\n\ntwo\n\nthree\n\ntail text\n\nx"


def test_html_all_articles_and_what_stands_with_them_stay():
    page = "<html><body><nav>menu</nav><main><h1>Headline</h1><p>lead</p><article>first</article><article>second and longer</article></main><footer>foot</footer></body></html>"
    assert html_extract.extract(page, None) == "Headline\n\nlead\n\nfirst\n\nsecond and longer"


def test_html_names_that_merely_have_a_word_of_boilerplate():
    page = "<html><body><article><p>See the text.</p><div class='related-work'>Work of others.</div><section id='search-results'>Results of the search.</section><p class='x'>Then</p><div class='form-factor'>A factor.</div><div class='share-buttons'>Share</div><div class='related-reading'><a href='/a'>Other page</a> <a href='/b'>Another</a></div></article></body></html>"
    assert html_extract.extract(page, None) == "See the text.\n\nWork of others.\n\nResults of the search.\n\nThen\n\nA factor."


def test_html_wrapper_finds_content_without_telling_names(spark):
    def page(k):
        teaser = f"<div class='qb'><p>Buy thing {k} now, it is the very best thing that you can buy in all the town and more, {'really ' * (40 if k == 3 else 2)}.</p></div>"
        body = "".join(f"<p>Sentence {k} {i} of the main text, which goes on for a while.</p>" for i in range(2 if k == 3 else 12))
        return f"<html><body><div class='qa'><b>Some Site</b> since 1999</div>{teaser}<div class='qc'><h1>Title {k}</h1>{body}<div class='qe'>All rights to the words of this site stay here.</div></div><div class='qd'>Page {k} of it</div></body></html>"

    pages = [page(k) for k in range(12)]
    got = extracted(spark, pages)
    for k, text in enumerate(got):
        n = 2 if k == 3 else 12
        assert text == "\n\n".join([f"Title {k}", *(f"Sentence {k} {i} of the main text, which goes on for a while." for i in range(n))])
    alone = html_extract.extract(pages[3], None)
    assert "Buy thing" in alone and "since 1999" in alone  # nothing tells them by name
    boxed = [x.replace("<div class='qc'>", "<article>").replace("stay here.</div></div>", "stay here.</div></article>") for x in pages]
    assert not any("All rights" in x for x in extracted(spark, boxed)) and "All rights" in html_extract.extract(boxed[0], None)
    assert all("All rights" in x for x in extracted(spark, boxed[:9]))  # too few pages to tell it from near copies


def test_html_equals_a_plain_reading_of_the_table(spark):
    import html as H
    import re

    def plain(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)) for x in re.split(r"</?(?:p|h\d|li|ul|ol|div|table|tr|td|th|blockquote|pre)\b[^>]*>", inner))
        return "\n\n".join(y for x in blocks if (y := " ".join(H.unescape(x).split())))

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op1_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: (plain(x or "<article></article>"), len(plain(x or "<article></article>"))) for k, x in pages.items()}


def test_html_nulls_clashes_copies_and_empty_tables(spark):
    rows = [(1, "http://h/1", "<p>one</p>", "a"), (1, "http://h/1", "<p>one</p>", "a"), (None, None, None, None), (2, "http://h/2", "", "b"), (3, "no host", "<p>" + "long " * 100000 + "</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __host string").withColumns({c: F.lit("mine") for c in ("text", "__page", "__wrapper", "__salt")})
    for limit in (html_extract.BROADCAST_BYTES, -1):
        html_extract.BROADCAST_BYTES, before = limit, html_extract.BROADCAST_BYTES
        try:
            got = sorted((r["page_id"] or 0, r["text"][:9], r["__host"], r["__page"]) for r in html_extract.extract_text(df).collect())
            assert got == [(0, "", None, "mine"), (1, "one", "a", "mine"), (1, "one", "a", "mine"), (2, "", "b", "mine"), (3, "long long", "c", "mine")]
            assert html_extract.extract_text(df.where("false")).collect() == []
        finally:
            html_extract.BROADCAST_BYTES = before


def test_html_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice([*"abcd", None]) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x is not None and x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_extract.common(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_empty_tables_and_clashing_names(spark, docs):
    clash = docs.withColumns({c: F.lit("mine") for c in ("n_words", "kept", "items", "n_hit", "n_tokens", "simhash", "component_id", "lang_pred", "score", "log_score", "__text", "__words", "__row", "__w", "__item")})
    bench = spark.createDataFrame([(1, TEXTS[0]), (2, None)], "item_id long, text string")
    for rows, n in ((clash, len(TEXTS)), (clash.where("false"), 0)):
        assert quality.quality_rules(rows).where("__words = 'mine'").count() == n
        assert decontaminate.decontaminate(rows, bench).where("__row = 'mine' and __w = 'mine'").count() == n
        assert lm_score.lm_scores(rows).where("__row = 'mine'").count() == n
        assert len(simhash.near_duplicates(rows).select("component_id", "__text").collect()) == n
        assert len(token_counts.token_counts(rows, VOCABULARY).collect()) == n
        assert len(bpe.bpe_round_trip(rows, VOCABULARY).collect()) == n


def test_decontamination_hits(spark, docs):
    bench = spark.createDataFrame([(1, TEXTS[0]), (2, "two three four five six seven eight nine"), (3, "")], "item_id long, text string")
    r = decontaminate.decontaminate(docs, bench).where("doc_id = 0").first()
    assert (r["n_hit"], r["items"], r["contaminated"]) == (10, ["1", "2"], True)


@pytest.mark.parametrize("slop", [1, 2])
def test_decontamination_proximity_by_brute_force(spark, slop):
    rng = random.Random(slop)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(14))] for _ in range(60)]
    items = [[rng.choice("abcdefg") for _ in range(4)] for _ in range(6)]
    want = []
    for ws in texts:
        inside, found = set(), set()
        for k, p in enumerate(items):
            for start in range(-len(p) - slop, len(ws) + slop + 1):
                if all(w in ws[max(start + i - slop, 0) : max(start + i + slop + 1, 0)] for i, w in enumerate(p)):
                    inside |= {*range(start, start + len(p))} & {*range(len(ws))}
                    found.add(str(k))
        want.append((len(inside), sorted(found)))
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, size=4, slop=slop).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["items"]) for r in got] == want and any(x[0] for x in want)


def components_of(prints):
    """The least key reachable over links of two or fewer bits, by comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def plain_quality(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeated = len({i + k for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)})
    if n < 10 or 100 * repeated > 20 * n:
        return False
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    echo = sum(a == b for a, b in zip(words, words[1:]))
    shout = sum(len(w) > 1 and w == w.upper() and w != w.lower() for w in words)
    bullets, dots = sum(bool(re.match(r"\s*[-*\u2022]\s", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|\u2026)\s*$", x)) for x in lines)
    over = [chars < 2 * n, chars > 16 * n, symbols > 0.25 * n, n >= 50 and stop < 0.02 * n, echo > 0.3 * n, shout > 0.6 * n]
    return not any(over) and not any((len(lines) - len({*lines}) > 0.5 * len(lines), bullets > 0.9 * len(lines), dots > 0.3 * len(lines)))


def plain_words(text):
    import re

    low = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def test_pipeline_by_brute_force(spark):
    """Each stage against a plain reading of what its predecessor kept; the language stage against its own predictions."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 8]) for w in items if w for i in range(max(len(w) - 7, 1))}
    sizes = {len(w) for w in windows}
    tok = Tokenizer.from_file(VOCABULARY)
    dropped = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, docs, DIR)
        assert now.columns == docs.columns
        if name == "quality rules":
            want = {k: x for k, x in kept.items() if plain_quality(x)}
        elif name == "language id":
            model = language.train(docs)
            sure = {k for k, x in kept.items() for lang, score in [model.predict(x)] if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
            want = {k: x for k, x in kept.items() if k in sure}
        elif name == "simhash near-dedup":
            want = {k: kept[k] for k in {*components_of({k: brute_fingerprint(x) for k, x in kept.items()}).values()}}
        else:
            split = {k: plain_words(x) for k, x in kept.items()}
            hit = {k for k, w in split.items() for n in sizes if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))}
            want = {k: x for k, x in kept.items() if k not in hit}
        docs = now
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        dropped[name], kept = len(kept) - len(want), want
    assert dropped["quality rules"] and dropped["simhash near-dedup"] and dropped["benchmark decontamination"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = {k: tok.encode(x or "", add_special_tokens=False).ids for k, x in kept.items()}
    want = {(k, len(ids), sha(",".join(map(str, ids)).encode()), sha(tok.decode(ids, skip_special_tokens=False).encode())) for k, ids in coded.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_pipeline_drops_planted_passages_and_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    vocabulary = "the of and to in is that it for on was with as by this are from or river stone house garden winter paper letter bridge market window doctor teacher music yellow silver river morning evening travel answer question number people water fire forest mountain".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(k, text(20)) for k in range(4)]
    clean = [text(60) for _ in range(6)]
    rows = [(k, x) for k, x in enumerate(clean)]
    rows += [(10, text(30) + " " + items[0][1][:-1] + " " + text(30)), (11, clean[0]), (12, None), (13, ""), (14, "|"), (0, clean[0]), (None, text(50))]
    at = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, part in (("full", rows), ("none", [])):
        (tmp_path / name).mkdir()
        docs = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in part], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/{name}/benchmark.parquet")
        found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, f"{at}/{name}").collect())
        assert found == ([(False, k) for k in range(6)] + [(True, 0)] if part else [])
