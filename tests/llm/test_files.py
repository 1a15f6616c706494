import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from heddle.llm import encoding, packing, sstable, urls, warc
from heddle.llm.common import shared_dir

ODD = ["", " ", "  a  b ", "a\n\n b", "İstanbul ΣΑΣ ς", "it's I'LL don'T 'S", "x\t y\r\n z", "naïve é ́ a", "<|endoftext|> b", "a<|endoftext|>", "x <|startoftext|> y  <|ENDOFTEXT|>", "日本語 テキスト １２³", "a\x1cb \x85 c d", "trailing \n", "\n lead", "a × b÷c _x_ __ !!", "₂²½ 12,3", "a" * 3000, "😀 😀😀 a😀", "a  'll  b 's"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name, monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 50)
    monkeypatch.setattr(encoding, "PRETOKENS", 40)
    path = encoding.tokenizer_path(name)
    library, rng = Tokenizer.from_file(path), random.Random(6)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "²", "!!", "Σ", "日", "́", "\xa0", "\x1c", "_", "-", "Word", "ther,"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for width in (2, 4):
        got = encoding.Encoder(path, width).encode([*texts, None])
        assert got[-1] == b""
        for t, g in zip(texts, got, strict=False):
            assert np.frombuffer(g, f"<u{width}").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# -- packing ------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(spark, odd_documents):
    library = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack(odd_documents).collect()
    want = []
    for d in odd_documents.collect():
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d["doc_id"], i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    used = check_packing(rows, 2048)
    assert used == -(-sum(r["length"] for r in rows) // 2048)


def test_plan_is_best_fit():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([10, 37, 64])
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 50) for _ in range(rng.randrange(1, 20))}
        slots, count = packing.plan(histogram, capacity)
        seen, fill = {k: set() for k in histogram}, {}
        for length, rank, n, first, offset in slots:
            for i in range(n):
                assert rank + i not in seen[length]
                seen[length].add(rank + i)
                fill.setdefault(first + i, []).append((offset, length))
        assert {k: len(v) for k, v in seen.items()} == histogram and len(fill) == count
        for own in fill.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        rooms = []  # best fit decreasing, one piece at a time
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            best = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
            rooms += [capacity] * (best == len(rooms))
            rooms[best] -= length
        assert count == len(rooms)


def test_ranks_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    docs = spark.range(300).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text here' else concat('x ', id) end as text")
    rows = packing.pack(docs, capacity=16).collect()
    assert len(rows) == 300
    check_packing(rows, 16)


def test_packing_empty(spark, odd_documents):
    assert packing.pack(odd_documents.where("false")).count() == 0


# -- token shards -------------------------------------------------------------------------------


def test_shards_round_trip(spark, odd_documents):
    library = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    rows = sstable.token_shards(odd_documents).collect()
    at, want = 0, []
    for d in sorted(odd_documents.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert sstable.token_shards(odd_documents.where("false")).count() == 0


def test_shards_of_ties_and_small_shards(spark, monkeypatch):
    rows = [(3, f"text {i % 4}") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(i, "one " * 50) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    starts = lambda d: sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.token_shards(d).collect()), key=repr)
    want = starts(docs)
    assert starts(docs.orderBy(sstable.F.rand(1)).repartition(7)) == want
    assert [r[1] for r in sorted(want, key=lambda r: r[1])] == [0, *np.cumsum([r[2] for r in sorted(want, key=lambda r: r[1])])[:-1]]
    write, folder = sstable.write_shards, shared_dir(spark, "few")
    monkeypatch.setattr(sstable, "SHARD_BYTES", 300)
    shards = write(docs, folder)
    assert shards.count() > 8 and sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(shards, folder).collect()), key=repr) == want


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_lookups(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 300)
    out, ids = Buffer(), {i: np.arange(i % 40, dtype="<u2") for i in range(-500, 9000, 7)}
    writer = sstable.Writer(out, 2)
    for i in sorted(ids):
        writer.add(sstable.key_of(i), ids[i].tobytes())
    writer.close()
    reader = sstable.Reader(out)
    assert len(reader.blocks) > 50 and reader.count == len(ids)
    assert all(np.array_equal(reader.get(i), ids[i]) for i in ids)
    missing = [i for i in range(-600, 9100) if i not in ids]
    assert all(reader.get(i) is None for i in missing) and reader.get(None) is None
    assert sum(reader.may_hold(sstable.key_of(i)) for i in missing) < 0.05 * len(missing)
    assert [sstable.id_of(k) for k, _, _ in reader.entries()] == sorted(ids)
    damaged = Buffer(out.getvalue()[:50] + b"\xff" + out.getvalue()[51:])
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(damaged).entries())
    with pytest.raises(ValueError, match="cut off"):
        sstable.Reader(Buffer(out.getvalue()[:-3]))


# -- WARC ---------------------------------------------------------------------------------------


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_round_trip(spark):
    big = "é" * 400_000
    rows = [(5, "http://a/", "x"), (3, "http://b/", "x"), (9, None, None), (7, "http://c/\r\nX: y", ""), (1, "u", big), (None, "n", "x"), (None, "n", "alone"), (3, "http://b/", "x"), (2, "r", "WARC/1.1\r\n\r\nfalse start\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(pages).collect()
    first = {"x": 3, "": 7}
    want = []
    for page, _, html in rows:
        payload, keep = (html or "").encode(), first.get(html or "", page)
        revisit = keep != page
        want.append((page, len(payload), b32(payload), "revisit" if revisit else "response", keep if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_normaliser_makes_members_and_index():
    records = [warc.record(i, f"http://h/{i}", bytes([65 + i % 26]) * (i * 977 % 70_000), None) for i in range(60)]
    for source in (zlib.compress(b"".join(records), wbits=31), b"".join(zlib.compress(b"".join(records[i : i + 7]), wbits=31) for i in range(0, 60, 7))):
        target, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(source), target, index) == 60
        for i, line in enumerate(index.getvalue().decode().splitlines()):
            at, size, kind, name, _ = line.split(" ")
            raw = target.getvalue()[int(at) : int(at) + int(size)]
            assert zlib.decompress(raw, 31) == records[i] and kind == "response" and warc.page_of(name) == i
        assert b"".join(zlib.decompress(x, 31) for x in [target.getvalue()[int(v[0]) : int(v[0]) + int(v[1])] for v in (x.split(" ") for x in index.getvalue().decode().splitlines())]) == b"".join(records)
    with pytest.raises(ValueError, match="cut off"):
        warc.normalise(io.BytesIO(zlib.compress(b"".join(records), wbits=31)[:-500]), io.BytesIO(), io.BytesIO())


def test_shared_folder_is_new_each_time(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


# -- urls ---------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    rows = [
        (1, "https://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "http://b.com/en/", "b.com", "/en/", "com/en/", "block"), (3, "http://x.example.net/de/81#f", "x.example.net", "/de/81", "example.net/de/8", "block"),
        (4, "ftp://notcom/en/", "notcom", "/en/", None, None), (5, None, "", "", None, None), (6, "no scheme/en/", "", "", None, None), (7, "a://b://c/d?e", "b:", "//c/d", None, None), (8, "http://q?x=://y/", "q", "", None, None), (9, "http://com/en/1", "com", "/en/1", "com/en/", "block"), (10, "http://net/de/", "net", "/de/", "net/de/", "allow"),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")).collect()}
    for i, _, host, path, rule, verdict in rows:
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict), i


def test_reputation_is_shrunk(spark):
    bad = [("evil.org", "/es/") for _ in range(40)] + [("a.evil.org", "/es/") for _ in range(30)]
    good = [(f"h{i}.net", "/de/") for i in range(60)]
    free = [("evil.org", "/x"), ("new.evil.org", "/x"), ("h1.net", "/x"), ("new.net", "/x")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(bad + good + free)], "page_id long, url string")
    got = {r["host"]: r["verdict"] for r in urls.judge(pages).where("path = '/x'").collect()}
    assert got == {"evil.org": "block", "new.evil.org": "block", "h1.net": "allow", "new.net": "allow"}
    uk = spark.createDataFrame([(f"{x}.co.uk", n, k) for x, n, k in (("bad", 50, 50), ("www.bad", 0, 0), ("good", 50, 0), ("new", 0, 0))], "host string, n long, k long")
    low = {r["host"]: r["bad_mean"] for r in urls.reputations(uk, ("co.uk",)).collect()}
    assert low["www.bad.co.uk"] > 0.9 and low["good.co.uk"] < 0.1 and 0.3 < low["new.co.uk"] < 0.7
    nothing = urls.judge(spark.createDataFrame([(1, "http://a/"), (None, None)], "page_id long, url string")).collect()
    assert {r["verdict"] for r in nothing} == {"allow"} and urls.judge(pages.where("false")).count() == 0


def test_a_worker_keeps_its_encoder(monkeypatch):
    path = encoding.tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(encoding, "KEPT", 20)
    encoding.kept_encoder.cache_clear()
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j)}" for j in range(26)) for i in range(40)]
    first = encoding.kept_encoder(path, 2)
    got = [encoding.kept_encoder(path, 2).encode([t])[0] for t in texts]  # each call as a task of its own
    assert encoding.kept_encoder(path, 2) is first and len(first.pieces) <= 22
    assert got == encoding.Encoder(path, 2).encode(texts)
    encoding.kept_encoder.cache_clear()
